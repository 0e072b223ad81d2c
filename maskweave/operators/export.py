"""Sinks: rewritten texts and mapping, encrypted mapping, page spans, redaction requests, snapshots."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions import dialect
from maskweave.operators.patterns import PAGE_HEADER
from maskweave.operators.spans import matches

# Key derivation and payload format
ITERATIONS, SALT_BYTES, IV_BYTES, VERSION, KDF, LEAST_PASSPHRASE = 200_000, 16, 12, 1, "PBKDF2-SHA256", 8
SNAPSHOT_VERSION = 2


def page_spans(text: Column) -> Column:
    """array<struct<start, end, file, page>> of a corpus text: a page ends where the next header begins."""
    pattern = dialect.java(PAGE_HEADER)
    heads = F.transform(
        matches(text, pattern),
        lambda h: F.struct(h["start"].alias("at"), (h["start"] + F.length(h["text"])).alias("start"), F.regexp_extract(h["text"], pattern, 1).alias("file"), F.regexp_extract(h["text"], pattern, 2).try_cast("int").alias("page")),
    )
    ends = F.concat(F.transform(F.slice(heads, 2, F.greatest(F.size(heads), F.lit(1))), lambda h: h["at"]), F.array(F.length(text).cast("bigint")))
    return F.zip_with(heads, F.slice(ends, 1, F.size(heads)), lambda h, e: F.struct(h["start"], e.alias("end"), h["file"], h["page"]))


def redaction_requests(corpora: DataFrame, keys: list[str], text: str = "text", entities: str = "entities") -> DataFrame:
    """Distinct (keys, file, page, text) of enabled entities, by the page that holds their start."""
    pages = corpora.select(*keys, entities, page_spans(F.col(text)).alias("__p"))
    hit = lambda e: F.get(F.filter("__p", lambda p: (e["start"] >= p["start"]) & (e["start"] < p["end"])), F.lit(0))
    rows = F.transform(F.filter(entities, lambda e: e["enabled"]), lambda e: F.struct(hit(e)["file"].alias("file"), hit(e)["page"].alias("page"), e["text"].alias("text")))
    return pages.select(*keys, F.inline(rows)).filter("page is not null").distinct()


def requests_by_rows(entities: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The same where a corpus is spread over rows: an interval join of entity starts with page spans, per corpus."""
    inside = (F.col("e.start") >= F.col("p.start")) & (F.col("e.start") < F.col("p.end"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    on = inside
    for s in same:
        on = s & on
    joined = entities.filter("enabled").alias("e").join(pages.alias("p"), on)
    return joined.select(*[F.col(f"e.{k}") for k in keys], F.col("p.file"), F.col("p.page"), F.col("e.text")).distinct()


def write_texts(rows: DataFrame, folder: str, key: str, text: str = "text", anon: str = "text_anon", mapping: str = "mapping", app: str = "maskweave") -> None:
    """Rewritten texts, originals and mappings, each in a folder of its own."""
    rows.select(key, F.col(anon).alias("text")).write.mode("overwrite").parquet(f"{folder}/texts")
    rows.select(key, F.col(text).alias("text")).write.mode("overwrite").parquet(f"{folder}/originals")
    document = F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"), F.lit(app).alias("app"), F.from_json(mapping, "map<string,string>").alias("entries")))
    rows.select(key, document.alias("value")).write.mode("overwrite").json(f"{folder}/mappings")


def write_files(rows: DataFrame, folder: str, key: str, passphrase: str | None = None, text: str = "text", anon: str = "text_anon", mapping: str = "mapping", app: str = "maskweave") -> DataFrame:
    """One set of files per corpus, as a user opens them: x.txt, x.mapping.json (or x.mapping.enc.json) and x.original.txt.

    The folder is one that all executors share.  Files are written under temporary names and renamed, so a task that
    runs again leaves whole files.  Keys must be distinct names without slashes; null texts become empty files.
    Returns (key, file, bytes).  The key of an encrypted mapping is derived once per file, from a salt of its own.
    """
    if passphrase is not None and len(passphrase) < LEAST_PASSPHRASE:
        raise ValueError(f"the passphrase needs {LEAST_PASSPHRASE} characters")
    names = rows.select(F.col(key).cast("string").alias("k"))
    if bad := names.groupBy("k").count().filter("k is null or k = '' or k in ('.', '..') or k like '%/%' or count > 1").first():
        raise ValueError(f"not a distinct file name: {bad.k}")
    generated = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    picked = rows.select(F.col(key).cast("string").alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(anon, F.lit("")).alias("a"), F.coalesce(mapping, F.lit("{}")).alias("m"))
    if passphrase is not None:
        wrapped = F.to_json(F.struct(F.lit(generated).alias("generated_at"), F.lit(app).alias("app"), F.from_json("m", "map<string,string>").alias("entries")))
        picked = sealed(picked.withColumn("m", wrapped), passphrase)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for k, original, anonymous, entries in batch[["k", "t", "a", "m"]].itertuples(index=False):
                document = entries if passphrase is not None else json.dumps({"generated_at": generated, "app": app, "entries": json.loads(entries)}, ensure_ascii=False, indent=2)
                for file, body in ((f"{k}.txt", anonymous), (f"{k}.mapping.{'enc.' if passphrase is not None else ''}json", document), (f"{k}.original.txt", original)):
                    raw = body.encode()
                    with tempfile.NamedTemporaryFile(dir=folder, prefix=".", delete=False) as f:
                        f.write(raw)
                    os.replace(f.name, os.path.join(folder, file))
                    yield pd.DataFrame([(k, file, len(raw))], columns=["key", "file", "bytes"])

    return picked.mapInPandas(run, "key string, file string, bytes long")


def sealed(rows: DataFrame, passphrase: str) -> DataFrame:
    """rows with m replaced by its AES-256-GCM payload; the passphrase travels in a closure, never as part of a plan."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.BinaryType()) for c in ("salt", "iv", "key")]))
    def secrets_of(texts: pd.Series) -> pd.DataFrame:
        salts = [os.urandom(SALT_BYTES) for _ in texts]
        return pd.DataFrame({"salt": salts, "iv": [os.urandom(IV_BYTES) for _ in texts], "key": [derive_key(passphrase, s) for s in salts]})

    out = rows.withColumn("s", secrets_of.asNondeterministic()(F.col("m")))
    whole = F.aes_encrypt(F.encode("m", "UTF-8"), F.col("s.key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("s.iv"))
    text = lambda c, label: F.regexp_replace(F.base64(c), r"\s", "").alias(label)
    ct = F.expr(f"substring(whole, {IV_BYTES + 1})")
    payload = F.struct(F.lit(VERSION).alias("v"), F.lit(KDF).alias("kdf"), F.lit(ITERATIONS).alias("iterations"), text(F.col("s.salt"), "salt"), text(F.col("s.iv"), "iv"), text(ct, "ct"))
    return out.withColumn("whole", whole).withColumn("m", F.to_json(payload)).drop("s", "whole")


def derive_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ITERATIONS)


def encrypt_mapping(spark: SparkSession, mapping: str, passphrase: str, salt: bytes | None = None, iv: bytes | None = None) -> dict:
    """AES-256-GCM payload of a mapping's JSON.  The key is passed as data, never as part of a plan."""
    if len(passphrase) < LEAST_PASSPHRASE:
        raise ValueError(f"the passphrase needs {LEAST_PASSPHRASE} characters")
    salt, iv = salt or os.urandom(SALT_BYTES), iv or os.urandom(IV_BYTES)
    row = spark.createDataFrame([(mapping.encode(), derive_key(passphrase, salt), iv)], "data binary, k binary, iv binary")
    sealed = bytes(row.select(F.aes_encrypt("data", "k", F.lit("GCM"), F.lit("DEFAULT"), F.col("iv"))).first()[0])
    text = lambda b: base64.b64encode(b).decode()
    return {"v": VERSION, "kdf": KDF, "iterations": ITERATIONS, "salt": text(salt), "iv": text(iv), "ct": text(sealed[IV_BYTES:])}


def decrypt_mapping(spark: SparkSession, payload: dict, passphrase: str) -> str:
    if payload.get("v") != VERSION:
        raise ValueError(f"unsupported version: {payload.get('v')}")
    salt, iv, ct = (base64.b64decode(payload[k]) for k in ("salt", "iv", "ct"))
    row = spark.createDataFrame([(iv + ct, derive_key(passphrase, salt))], "data binary, k binary")
    return bytes(row.select(F.aes_decrypt("data", "k", F.lit("GCM"))).first()[0]).decode()


def save_snapshot(rows: DataFrame, path: str) -> None:
    rows.withColumn("schema_version", F.lit(SNAPSHOT_VERSION)).write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of another version is refused."""
    rows = spark.read.parquet(path)
    if rows.filter(F.col("schema_version") != SNAPSHOT_VERSION).limit(1).count():
        raise ValueError("snapshot of another version")
    return rows.drop("schema_version")
