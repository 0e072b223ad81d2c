"""A corpus of French case files, built from `customer` by SQL that Spark and DuckDB both run.

Every detection pattern fires on it, which the generated documents do not make happen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOSSIER = """
WITH k AS (
  SELECT c_custkey AS k,
         split_part('Jean,Marie,Paul,Claire,Luc,Anne,Hugo,Sophie', ',', cast(c_custkey % 8 AS int) + 1) AS fn,
         split_part('DUPONT,MARTIN,LEFEBVRE,MOREAU,GARNIER,ROUSSEAU,FAURE,CHEVALIER,BLANCHARD,PERRIN,MERCIER,RENAUD', ',', cast(c_custkey % 12 AS int) + 1) AS ln,
         split_part('Dupont,Martin,Lefebvre,Moreau,Garnier,Rousseau,Faure,Chevalier,Blanchard,Perrin,Mercier,Renaud', ',', cast(c_custkey % 12 AS int) + 1) AS lnc,
         split_part('Paris,Lyon,Lille,Nantes,Rennes', ',', cast(c_custkey % 5 AS int) + 1) AS city,
         cast((1 + c_custkey % 2) * 1000000000000 + (40 + c_custkey % 60) * 10000000000 + (1 + c_custkey % 12) * 100000000
              + (1 + c_custkey % 95) * 1000000 + (c_custkey * 37) % 1000 * 1000 + (c_custkey * 91) % 1000 AS bigint) AS n13,
         concat('20041', lpad(cast(c_custkey % 100000 AS string), 5, '0'), lpad(cast(c_custkey * 7919 AS string), 11, '0'), lpad(cast(c_custkey % 97 AS string), 2, '0')) AS bban,
         cast(10000000 + (c_custkey * 104729) % 89999999 AS string) AS s8
  FROM customer
), d AS (
  SELECT *, 97 - n13 % 97 AS nkey,
         ((cast(substr(concat(bban, '152700'), 1, 15) AS bigint) % 97) * 100000000000000 + cast(substr(concat(bban, '152700'), 16, 14) AS bigint)) % 97 AS imod,
         (cast(substr(s8,1,1) AS int) + cast(substr(s8,3,1) AS int) + cast(substr(s8,5,1) AS int) + cast(substr(s8,7,1) AS int)
          + 2 * (cast(substr(s8,2,1) AS int) + cast(substr(s8,4,1) AS int) + cast(substr(s8,6,1) AS int) + cast(substr(s8,8,1) AS int))
          - 9 * (CASE WHEN substr(s8,2,1) > '4' THEN 1 ELSE 0 END + CASE WHEN substr(s8,4,1) > '4' THEN 1 ELSE 0 END
               + CASE WHEN substr(s8,6,1) > '4' THEN 1 ELSE 0 END + CASE WHEN substr(s8,8,1) > '4' THEN 1 ELSE 0 END)) % 10 AS lsum
  FROM k
), e AS (
  SELECT *, cast(n13 AS string) AS s13,
         lpad(cast(CASE WHEN k % 3 = 0 THEN nkey % 97 + 1 ELSE nkey END AS string), 2, '0') AS nk2,
         lpad(cast(CASE WHEN k % 4 = 0 THEN (98 - imod) % 97 + 2 ELSE 98 - imod END AS string), 2, '0') AS ic2,
         cast((10 - lsum + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 10 AS string) AS sc,
         lpad(cast(1 + k % 28 AS string), 2, '0') AS dd, lpad(cast(1 + k % 12 AS string), 2, '0') AS mm
  FROM d
)
SELECT k AS doc_id, concat(
  'Monsieur ', fn, ' ', ln, ', né le ', dd, '/', mm, '/', cast(1940 + k % 60 AS string), ', demeurant à ', city, ', ',
  cast(1 + k % 200 AS string), ' rue de la République, 75011 PARIS', chr(10),
  'numéro de sécurité sociale ', substr(s13,1,1), ' ', substr(s13,2,2), ' ', substr(s13,4,2), ' ', substr(s13,6,2), ' ', substr(s13,8,3), ' ', substr(s13,11,3), ' ', nk2,
  ', IBAN FR', ic2, ' ', substr(bban,1,4), ' ', substr(bban,5,4), ' ', substr(bban,9,4), ' ', substr(bban,13,4), ' ', substr(bban,17,4), ' ', substr(bban,21,3),
  ', tél. 06 ', dd, ' ', mm, ' 98 76, email ', lower(fn), '.', lower(ln), '@example.fr', chr(10),
  'Madame Marie ', lnc, ', gérante de la société ', ln, ' SARL (SIREN ', substr(s8,1,3), ' ', substr(s8,4,3), ' ', substr(s8,7,2), sc, '), véhicule AB-', lpad(cast(k % 1000 AS string),3,'0'), '-CD.', chr(10),
  'Le ', cast(1 + k % 28 AS string), ' avril 2026, le Tribunal judiciaire de ', city, ', RG n° 26/', lpad(cast(k % 100000 AS string),5,'0'), ', audience du ', dd, '/', mm, '/2026, Président : ', fn, ' Valois.', chr(10),
  'Me Paul TESTEUR, avocat de Monsieur ', ln, '. ', fn, ' ', lnc, 's conclut au rejet.', chr(10),
  'ENTRE : Luc RIVIERE, né à Bordeaux, de nationalité française, représenté par Me Anne COLIN, avocat au Barreau de Nice.', chr(10),
  'Pour le requérant Marc OLIVIER et les consorts Jean BESSON : SAS Alpha Travaux, Cabinet Durand, véhicule 1234 AB 75, PARQUET n° 21/12345.', chr(10),
  'Cour composée de Mme Hélène Vidal ; Claire GIRAUD, née le 3 mars 1980, décédée le ', dd, '/', mm, '/2020.') AS text
FROM e
"""


def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), one case file per customer; dealt out, as a small table is one partition and its texts are not small."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(DOSSIER.replace("FROM customer", "FROM {customer}"), customer=customer)
