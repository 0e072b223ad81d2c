"""Detection, refinement, resolution, numbering and rewriting on literal rows."""

import pytest
from pyspark.sql import functions as F

from maskweave.operators import analyse, pseudonym, refine, resolve, spans
from maskweave.operators.patterns import Pattern

SAMPLE = """
Madame Odile VERNET, née le 21/07/1969, demeurant 8 avenue des Tilleuls 33000 BORDEAUX,
sécurité sociale 2 69 07 33 063 118 37, compte FR61 1027 8000 2000 1234 5678 915,
portable 07 12 34 56 78, courriel odile.vernet@example.org

Monsieur Karim Lebrun, associé de la société VERNET SAS (SIREN 532 176 484).

Le 9 mai 2025, le Tribunal judiciaire de Nantes a entendu les parties, audience du 14/02/2025.
Requête de Madame VERNET contre Monsieur Lebrun, reçue le 14/02/2025.

Me Sonia GARDELLE (sonia.gardelle@example.org, +33 4 56 78 90 12).
"""


@pytest.fixture(scope="module")
def run(spark):
    def go(text, only=None):
        row = analyse.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), only=only).first()
        return row

    return go


def found(row):
    return [(e.category, e.text) for e in row.entities]


@pytest.fixture(scope="module")
def sample(run):
    return run(SAMPLE)


def test_sample(sample):
    """A procedural date goes, but comes back as a copy of the same date elsewhere; a surname alone counts in capitals only."""
    assert found(sample) == [
        ("PERSONNE", "Odile VERNET"), ("DATE_NAISSANCE", "21/07/1969"), ("ADRESSE", "8 avenue des Tilleuls 33000 BORDEAUX"), ("NIR", "2 69 07 33 063 118 37"),
        ("IBAN", "FR61 1027 8000 2000 1234 5678 915"), ("TEL", "07 12 34 56 78"), ("EMAIL", "odile.vernet@example.org"), ("PERSONNE", "Karim Lebrun"), ("PERSONNE_MORALE", "VERNET SAS"),
        ("SIREN", "532 176 484"), ("DATE", "9 mai 2025"), ("JURIDICTION", "Tribunal judiciaire de Nantes"), ("DATE", "14/02/2025"), ("PERSONNE", "VERNET"), ("DATE", "14/02/2025"),
        ("AVOCAT", "Sonia GARDELLE"), ("EMAIL", "sonia.gardelle@example.org"), ("TEL", "+33 4 56 78 90 12"),
    ]
    assert [e.pseudonym for e in sample.entities if e.category == "PERSONNE"] == ["PERSONNE_001", "PERSONNE_002", "PERSONNE_003"]
    assert [e.enabled for e in sample.entities if e.category == "AVOCAT"] == [False]


def test_spans_slice_to_their_text(sample):
    assert all(SAMPLE[e.start : e.end] == e.text for e in sample.entities)
    assert all(a.end <= b.start for a, b in zip(sample.entities, sample.entities[1:]))


def test_rewriting_leaves_the_rest(sample):
    at, out = 0, []
    for e in sample.entities:
        if e.enabled:
            out += [SAMPLE[at : e.start], e.pseudonym]
            at = e.end
    assert sample.text_anon == "".join(out) + SAMPLE[at:]


def test_reidentification(spark, sample):
    row = spark.createDataFrame([(sample.text_anon, sample.mapping)], "t string, m string")
    assert row.select(pseudonym.reidentify(F.col("t"), F.from_json("m", "map<string,string>"))).first()[0] == SAMPLE


@pytest.mark.parametrize(
    "text, only, want",
    [
        ("éAB-123-CD", ("plate_new",), [("PLAQUE", "AB-123-CD")]),
        ("06 39 98 76 54", ("phone",), [("TEL", "06 39 98 76 54")]),
        ("NÉ LE 15/03/1978", ("birth_digits",), [("DATE_NAISSANCE", "15/03/1978")]),
        ("le 02/01/2026, audience du 02/01/2026", ("date_digits",), [("DATE", "02/01/2026"), ("DATE", "02/01/2026")]),
        ("audience du 02/01/2026", ("date_digits",), []),
        ("décédée le 02/01/2020", ("date_digits",), [("DATE_NAISSANCE", "02/01/2020")]),
        ("M. Paul Roy et paul royal", ("person_title",), [("PERSONNE", "Paul Roy"), ("PERSONNE", "paul roy")]),
        ("Madame Marie Durand puis Marie Durant", ("person_title",), [("PERSONNE", "Marie Durand"), ("PERSONNE", "Marie Durant")]),
        ("Madame Marie Durand puis Dbrie Durand", ("person_title",), [("PERSONNE", "Marie Durand")]),
        ("conseiller Dupont", ("lawyer_word",), [("AVOCAT", "ler Dupont")]),
        ("4785380592391139", ("phone",), [("TEL", "0592391139")]),
        ("Vu Code Civil DUPONT", ("person_caps",), []),
        ("NIR 1 80 12 99 999 999 23", ("nir",), []),
        ("SIREN 111 111 111", ("siren",), []),
        ("", None, []),
    ],
)
def test_edges(run, text, only, want):
    assert found(run(text, only)) == want


def test_null_text(run):
    row = run(None)
    assert row.text_anon is None and not row.entities


def test_long_runs_do_not_overflow(run):
    row = run("avocat " + "mot " * 20_000)
    assert [e.category for e in row.entities] == ["AVOCAT"]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], f"s {spans.SPANS}").select(column).first()[0]


@pytest.mark.parametrize(
    "given, want",
    [
        ([(0, 5, "LIEU", 1), (3, 9, "AVOCAT", 0)], [(0, 5, "LIEU")]),
        ([(0, 5, "MAGISTRAT", 1), (0, 5, "AVOCAT", 0)], [(0, 5, "AVOCAT")]),
        ([(0, 3, "NIR", 0), (0, 5, "SIREN", 1)], [(0, 5, "SIREN")]),
        ([(5, 7, "DATE", 0), (0, 5, "DATE", 1)], [(0, 5, "DATE"), (5, 7, "DATE")]),
    ],
)
def test_resolution(spark, given, want):
    made = one(spark, resolve.resolve(F.col("s")), [(a, b, "x", c, q) for a, b, c, q in given])
    assert [(x.start, x.end, x.category) for x in made] == want


def test_numbers_grow_past_three_digits(spark):
    rows = [(i * 10, i * 10 + 5, f"Nom {i}", "PERSONNE", i) for i in range(1001)]
    made = one(spark, pseudonym.number_rows(F.col("s")), rows)
    assert made[998].pseudonym == "PERSONNE_999" and made[999].pseudonym == "PERSONNE_1000" and made[1000].pseudonym == "PERSONNE_1001"


def test_one_number_per_form(spark):
    made = one(spark, pseudonym.number_rows(F.col("s")), [(0, 5, "Jean  Roy", "PERSONNE", 0), (9, 14, "jean roy", "PERSONNE", 1), (20, 25, "jean roy", "LIEU", 2)])
    assert [x.pseudonym for x in made] == ["PERSONNE_001", "PERSONNE_001", "LIEU_001"]


def test_numbering_goes_on(spark):
    rows = spark.createDataFrame([(1, 0, "Anne", "PERSONNE"), (1, 9, "Luc", "PERSONNE")], "doc_id long, start long, text string, category string")
    known = spark.createDataFrame([(1, "PERSONNE", "luc", "PERSONNE_007"), (1, "OTHER", "x", "OTHER_001")], "doc_id long, category string, norm_text string, pseudonym string")
    made = {r.norm_text: r.pseudonym for r in pseudonym.number_corpus(rows, ["doc_id"], known).collect()}
    assert made == {"luc": "PERSONNE_007", "anne": "PERSONNE_008"}


def test_numbering_goes_on_over_odd_mappings(spark):
    """Numbers stay in a corpus without a name and where a form has two; forms that do not come again still count."""
    kind = "doc_id long, start long, text string, category string"
    rows = [(1, 0, "Zoé", "PERSONNE"), (1, 5, "Anne", "PERSONNE"), (1, 9, "ANNE", "PERSONNE"), (1, 20, "Luc", "PERSONNE"), (1, 30, "Nice", "LIEU"), (2, 0, "Anne", "PERSONNE"), (None, 0, "Luc", "PERSONNE"), (None, 9, "Zoé", "PERSONNE"), (None, 20, None, "PERSONNE")]
    known = [(1, "PERSONNE", "luc", "PERSONNE_007"), (1, "PERSONNE", "luc", "PERSONNE_003"), (1, "PERSONNE", "gone", "PERSONNE_011"), (1, "PERSONNE", "odd", "PERSONNE_x"), (None, "PERSONNE", "zoé", "PERSONNE_002"), (3, "LIEU", "lille", "LIEU_005")]
    found = pseudonym.number_corpus(spark.createDataFrame(rows, kind), ["doc_id"], spark.createDataFrame(known, "doc_id int, category string, norm_text string, pseudonym string"))
    assert dict(found.dtypes) == {"doc_id": "bigint", "category": "string", "norm_text": "string", "original": "string", "pseudonym": "string"}
    assert sorted((r.doc_id or 0, r.pseudonym, r.original or "") for r in found.collect()) == [
        (0, "PERSONNE_002", "Zoé"), (0, "PERSONNE_003", "Luc"), (0, "PERSONNE_004", ""), (1, "LIEU_001", "Nice"), (1, "PERSONNE_003", "Luc"), (1, "PERSONNE_007", "Luc"), (1, "PERSONNE_012", "Zoé"), (1, "PERSONNE_013", "Anne"), (2, "PERSONNE_001", "Anne"),
    ]


def test_case_files_are_analysed_once(spark, monkeypatch):
    """mapping_resumed numbers twice, but makes its resolved spans once."""
    from maskweave.plans import catalog

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(d, 10 * k, f"a{k % 7}@b.fr", "EMAIL") for d in range(20) for k in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, start long, text string, category string").mapInArrow(counted, "doc_id long, start long, text string, category string")
    monkeypatch.setattr(catalog, "_resolved", lambda *_: made)
    assert catalog._resumed(spark, "").count() == 20 * 7 and seen.value == len(rows)


@pytest.mark.parametrize("text, want", [("de la", []), ("le DUPONT", ["DUPONT"]), ("Marie de Villepin", ["Marie de Villepin"]), ("Me Paul TESTEUR", ["Paul TESTEUR"]), ("à Paris et", ["Paris"]), ("x", [])])
def test_particles(spark, text, want):
    df = spark.createDataFrame([(text, [(0, len(text), text, "LIEU", 0)])], f"t string, s {spans.SPANS}")
    assert [x.text for x in df.select(refine.trim_particles(F.col("t"), F.col("s"))).first()[0]] == want


def test_many_spans_in_one_text(spark):
    """20,000 spans: the chain behind detection takes seconds, not minutes."""
    import time

    n = 20_000
    text = "".join(f"{k % 1000:03d} a@b.fr é " for k in range(n))
    size = len("000 a@b.fr é ")
    kind = "array<struct<start:bigint,end:bigint,text:string,category:string,seq:bigint>>"
    found = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * size + 4).cast("bigint").alias("start"), (i * size + 10).cast("bigint").alias("end"), F.lit("a@b.fr").alias("text"), F.lit("EMAIL").alias("category"), i.cast("bigint").alias("seq")))
    row = spark.createDataFrame([(text,)], "text string").withColumn("spans", found.cast(kind))
    began = time.time()
    made = row.withColumn("kept", resolve.resolve(F.col("spans")))
    made = made.withColumn("entities", F.transform("kept", lambda x: F.struct(x["start"], x["end"], x["text"], x["category"], F.lit("EMAIL_001").alias("pseudonym"), F.lit(True).alias("enabled"))))
    out = made.select(F.size("kept").alias("n"), pseudonym.rewrite(F.col("text"), F.col("entities")).alias("t")).first()
    assert out.n == n and out.t == text.replace("a@b.fr", "EMAIL_001")
    assert time.time() - began < 60


@pytest.mark.parametrize("only", [("email",), None])
def test_own_patterns(spark, only):
    """A user's pattern gives the same spans among few patterns (built-in functions) and among all (Arrow)."""
    own = (Pattern("case_no", "NUM_DOSSIER", r"dossier\s+([A-Z]{2}-\d+)", True, 1, least=5), Pattern("badge", "PLAQUE", r"badge\s+\d+"))
    df = spark.createDataFrame([(1, "Dossier AB-1234 et dossier XY-7, badge 12, a@b.fr"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in analyse.pseudonymise(df, only=only, extra=own).collect()}
    assert found(rows[1]) == [("NUM_DOSSIER", "AB-1234"), ("PLAQUE", "badge 12"), ("EMAIL", "a@b.fr")] and not rows[2].entities
    assert rows[1].text_anon == "Dossier NUM_DOSSIER_001 et dossier XY-7, PLAQUE_001, EMAIL_001"


@pytest.mark.parametrize("bad", [Pattern("email", "EMAIL", "x"), Pattern("new", "NO_SUCH", "x"), Pattern("new", "EMAIL", "x", group=1)])
def test_own_patterns_refused(spark, bad):
    with pytest.raises(ValueError):
        spans.numbered(extra=(bad,))
