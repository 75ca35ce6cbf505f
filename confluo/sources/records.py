"""Records: a view derived from the customer, supplier and nation tables, packs in JSON, and a seeded generator."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ATTRIBUTES, ID, RECORD

#: Syllables of invented names.
SYLLABLES = "ba,be,bi,bo,bu,ca,ce,co,da,de,di,do,fa,fe,ga,go,la,le,li,lo,ma,me,mi,mo,na,ne,no,pa,pe,ra,re"
STREETS = "des lilas,du moulin,de la gare,victor hugo,jean jaures,des ecoles,pasteur,de la paix,du stade,des tilleuls,carnot,gambetta,de la mairie,saint martin,du lac,des roses,voltaire,du port,de lyon,des vignes,neuve,haute,basse"
TYPES = "rue,avenue,boulevard,place,chemin"

#: The view in SQL of both engines; {div} is integer division. Three sources; the second and third hold copies with one
#: corruption each: upper case, accents, a substituted letter, no email, swapped names, abbreviations, date order, another
#: first letter and postal code (blocking loses these), initials with an unknown date, and many at once (these look different).
VIEW = f"""
WITH base AS (
  SELECT c_custkey AS k, c_nationkey AS nk, n_name,
    concat(split_part('{SYLLABLES}', ',', cast(c_custkey % 31 + 1 AS int)), split_part('{SYLLABLES}', ',', cast((c_custkey {{div}} 31) % 29 + 1 AS int)), split_part('{SYLLABLES}', ',', cast((c_custkey * 7) % 31 + 1 AS int))) AS ln,
    concat(split_part('{SYLLABLES}', ',', cast((c_custkey * 5) % 31 + 1 AS int)), split_part('{SYLLABLES}', ',', cast((c_custkey {{div}} 3) % 29 + 1 AS int))) AS fn,
    1940 + c_custkey % 60 AS y, 1 + (c_custkey {{div}} 60) % 12 AS mo, 1 + (c_custkey {{div}} 7) % 28 AS dy,
    1 + c_custkey % 98 AS no, split_part('{TYPES}', ',', cast(c_custkey % 5 + 1 AS int)) AS ty, split_part('{STREETS}', ',', cast((c_custkey {{div}} 5) % 23 + 1 AS int)) AS st,
    10000 + c_nationkey * 1000 + (c_custkey % 40) * 10 AS cp, 100000000 + (c_custkey * 7919) % 899999999 AS ph
  FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey),
copies AS (
  SELECT *, 'A' AS s, -1 AS v FROM base
  UNION ALL SELECT *, 'B' AS s, cast((k {{div}} 3 + 1) % 10 AS int) AS v FROM base WHERE k % 3 = 0
  UNION ALL SELECT *, 'C' AS s, cast((k {{div}} 3 + 2) % 10 AS int) AS v FROM base WHERE k % 7 = 0)
SELECT concat(s, lpad(cast(k AS varchar(20)), 10, '0')) AS record_id, concat('SRC_', s) AS source_id,
  CASE v WHEN 0 THEN upper(ln) WHEN 1 THEN replace(ln, 'e', 'é') WHEN 2 THEN concat(substr(ln, 1, 2), 'x', substr(ln, 4)) WHEN 4 THEN fn WHEN 7 THEN concat('z', substr(ln, 2)) WHEN 8 THEN concat(substr(ln, 1, 4), 'wyx') ELSE ln END AS last_name,
  CASE v WHEN 0 THEN upper(fn) WHEN 4 THEN ln WHEN 8 THEN 'yvo' WHEN 9 THEN concat(substr(fn, 1, 1), '. ', substr(fn, 3, 1), '.') ELSE fn END AS first_name,
  CASE v WHEN 8 THEN concat(cast(y - 3 AS varchar(4)), '-01-31') WHEN 9 THEN 'unknown' WHEN 6 THEN concat(lpad(cast(dy AS varchar(4)), 2, '0'), '/', lpad(cast(mo AS varchar(4)), 2, '0'), '/', cast(y AS varchar(4))) ELSE concat(cast(y AS varchar(4)), '-', lpad(cast(mo AS varchar(4)), 2, '0'), '-', lpad(cast(dy AS varchar(4)), 2, '0')) END AS birth_date,
  concat(cast(no AS varchar(4)), ' ', CASE WHEN v = 5 THEN CASE ty WHEN 'avenue' THEN 'av.' WHEN 'boulevard' THEN 'bd' WHEN 'place' THEN 'pl' WHEN 'chemin' THEN 'ch' ELSE 'r.' END ELSE ty END, ' ', st) AS address,
  CASE WHEN v IN (6, 7) THEN cast(cp + 1 AS varchar(10)) ELSE cast(cp AS varchar(10)) END AS postal_code, n_name AS city,
  CASE WHEN v = 3 THEN NULL WHEN v = 8 THEN concat('other', cast(k AS varchar(20)), '@example.net') ELSE concat(fn, '.', ln, cast(k AS varchar(20)), '@example.org') END AS email,
  CASE v WHEN 8 THEN '0600000000' WHEN 5 THEN concat('+33 ', cast(ph AS varchar(12))) ELSE concat('0', cast(ph AS varchar(12))) END AS phone,
  concat('C', cast(k AS varchar(20))) AS true_entity
FROM copies
UNION ALL
SELECT concat('S', lpad(cast(s_suppkey AS varchar(20)), 10, '0'), sfx), concat('SRC_', sfx),
  CASE sfx WHEN 'A' THEN concat('Societe ', nm, ' SARL') ELSE concat('SARL Societe ', upper(nm)) END, NULL, NULL,
  concat(cast(1 + s_suppkey % 98 AS varchar(4)), ' ', split_part('{TYPES}', ',', cast(s_suppkey % 5 + 1 AS int)), ' ', split_part('{STREETS}', ',', cast(s_suppkey % 23 + 1 AS int))),
  cast(10000 + s_nationkey * 1000 + (s_suppkey % 40) * 10 AS varchar(10)), n_name, concat('contact@', nm, cast(s_suppkey AS varchar(20)), '.example.com'), NULL,
  concat('S', cast(s_suppkey AS varchar(20)))
FROM (SELECT s_suppkey, s_nationkey, concat(split_part('{SYLLABLES}', ',', cast(s_suppkey % 31 + 1 AS int)), split_part('{SYLLABLES}', ',', cast((s_suppkey {{div}} 31) % 29 + 1 AS int)), split_part('{SYLLABLES}', ',', cast((s_suppkey * 3) % 31 + 1 AS int))) AS nm FROM {{supplier}}) q
  JOIN {{nation}} ON s_nationkey = n_nationkey CROSS JOIN (SELECT 'A' AS sfx UNION ALL SELECT 'B' AS sfx) w
WHERE sfx = 'A' OR s_suppkey % 4 = 0
"""


def view_sql() -> str:
    """The view as DuckDB runs it."""
    return VIEW.format(div="//", customer="customer", nation="nation", supplier="supplier")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their true entity, which no engine stage may read."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "supplier")}
    return spark.sql(VIEW.format(div="div", customer="{customer}", nation="{nation}", supplier="{supplier}"), **tables)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select(*RECORD)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select(ID, "true_entity")


# Packs -----------------------------------------------------------------------------------------------------------

_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in RECORD])
PACK = T.StructType(
    [
        T.StructField("records", T.ArrayType(_RECORD)),
        T.StructField("ground_truth", T.ArrayType(T.StructType([T.StructField(ID, T.StringType()), T.StructField("true_entity", T.StringType())]))),
        T.StructField("corruption_annotation", T.ArrayType(T.StructType([T.StructField(ID, T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("origin", T.StringType())]))),
    ]
)


def pack_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON pack; the truth in the same file is not read into the plan."""
    only = T.StructType([PACK["records"]])
    return spark.read.option("multiLine", True).schema(only).json(path).select(F.explode("records").alias("r")).select("r.*")


def pack_truth(spark: SparkSession, path: str) -> DataFrame:
    only = T.StructType([PACK["ground_truth"]])
    return spark.read.option("multiLine", True).schema(only).json(path).select(F.explode("ground_truth").alias("r")).select("r.*")


def content_sha256(blocks: dict) -> str:
    """Fingerprint of a pack's content: canonical JSON of its blocks without the manifest."""
    body = {k: blocks[k] for k in sorted(blocks) if k != "manifest"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def review_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of a review transcription; keys are 64 hexadecimal digits and answers are not empty."""
    schema = T.StructType([T.StructField("answers", T.MapType(T.StringType(), T.StructType([T.StructField("case", T.StringType()), T.StructField("text", T.StringType())])))])
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("answers").alias("key", "v"))
    bad = ~F.col("key").rlike("^[0-9a-f]{64}$") | F.coalesce(F.trim("v.text"), F.lit("")).eqNullSafe("")
    return rows.select(F.when(bad, F.raise_error(F.concat(F.lit("bad review answer: "), F.col("key")))).otherwise(F.col("key")).alias("key"), F.col("v.text").alias("answer"))


def validated(rows: DataFrame, least: int = 2, most: int = 200, longest: int = 200) -> DataFrame:
    """Rows of an interface: trimmed, blank to null, with unique identifiers and within the limits, or an error."""
    out = rows.select(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RECORD))
    too_long = sum(F.sum(F.when(F.length(c) > longest, 1).otherwise(0)) for c in RECORD)
    n, ids, missing, long = out.agg(F.count("*"), F.countDistinct(ID), F.sum(F.col(ID).isNull().cast("int")), too_long).first()
    if not least <= n <= most:
        raise ValueError(f"{n} rows; {least} to {most} are taken")
    if missing or ids < n:
        raise ValueError("identifiers are missing or repeated")
    if long:
        raise ValueError(f"a value is longer than {longest} characters")
    return out


CORRUPTIONS = ("TYPO", "PHONETIC", "FORMAT", "MISSING", "TRUNCATION", "SWAP", "NOISE")


def generated(spark: SparkSession, seed: str, n_entities: int) -> DataFrame:
    """A synthetic population: clean entities, and for about half of them a copy with one to three corruptions.

    Every draw is a hash of seed, entity and purpose, so any partitioning gives the same rows. Columns: the record's,
    true_entity and the corruptions with an effect.
    """
    draw = lambda purpose, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(purpose)), F.lit(n)).cast("int")
    pick = lambda words, purpose: F.split_part(F.lit(words), F.lit(","), draw(purpose, len(words.split(","))) + 1)
    base = spark.range(n_entities)
    company = draw("company", 100) < 15
    last = F.initcap(F.concat(pick(SYLLABLES, "l1"), pick(SYLLABLES, "l2"), pick(SYLLABLES, "l3")))
    first = F.initcap(F.concat(pick(SYLLABLES, "f1"), pick(SYLLABLES, "f2")))
    rows = base.select(
        "id",
        F.when(company, F.concat(F.lit("Societe "), last, F.lit(" SARL"))).otherwise(last).alias("last_name"),
        F.when(~company, first).alias("first_name"),
        F.when(~company, F.concat_ws("-", (1940 + draw("y", 65)).cast("string"), F.lpad((1 + draw("m", 12)).cast("string"), 2, "0"), F.lpad((1 + draw("d", 28)).cast("string"), 2, "0"))).alias("birth_date"),
        F.concat_ws(" ", (1 + draw("no", 120)).cast("string"), pick(TYPES, "ty"), pick(STREETS, "st")).alias("address"),
        (10000 + draw("cp", 900) * 100).cast("string").alias("postal_code"),
        F.initcap(F.concat(pick(SYLLABLES, "c1"), pick(SYLLABLES, "c2"), F.lit("ville"))).alias("city"),
        F.lower(F.concat(first, F.lit("."), last, F.col("id").cast("string"), F.lit("@example.org"))).alias("email"),
        F.concat(F.lit("0"), (100000000 + draw("ph", 899999999)).cast("string")).alias("phone"),
    )
    clean = rows.select(F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("A")).alias(ID), F.lit("SRC_A").alias("source_id"), *ATTRIBUTES, F.concat(F.lit("E"), F.col("id").cast("string")).alias("true_entity"), F.array().cast("array<string>").alias("corruptions"))
    has = lambda k: draw(f"corrupt-{k}", 100) < 30
    c = F.col
    swapped = has("SWAP") & ~has("TYPO") & c("first_name").isNotNull()
    # A drawn corruption is listed where it changes a value.
    effect = {
        "TYPO": F.substring("last_name", 3, 1) != "x",
        "PHONETIC": F.substring("postal_code", 5, 1) != "7",
        "FORMAT": F.upper(F.regexp_replace("address", " avenue ", " av. ")) != c("address"),
        "MISSING": c("email").isNotNull(),
        "TRUNCATION": (F.length("first_name") > 3) & ~swapped,
        "SWAP": swapped & (c("first_name") != c("last_name")),
        "NOISE": F.lit(True),
    }
    dirty = rows.where(draw("copy", 100) < 48).select(
        "id",
        F.when(has("TYPO"), F.concat(F.substring("last_name", 1, 2), F.lit("x"), F.expr("substring(last_name, 4)"))).when(has("SWAP") & c("first_name").isNotNull(), c("first_name")).otherwise(c("last_name")).alias("last_name"),
        F.when(has("SWAP") & ~has("TYPO") & c("first_name").isNotNull(), c("last_name")).when(has("TRUNCATION") & (F.length("first_name") > 3), F.expr("substring(first_name, 1, length(first_name) - 1)")).otherwise(c("first_name")).alias("first_name"),
        "birth_date",
        F.when(has("FORMAT"), F.upper(F.regexp_replace("address", " avenue ", " av. "))).otherwise(c("address")).alias("address"),
        F.when(has("PHONETIC"), F.concat(F.substring("postal_code", 1, 4), F.lit("7"))).otherwise(c("postal_code")).alias("postal_code"),
        F.when(has("NOISE"), F.concat(c("city"), F.lit(" cedex"))).otherwise(c("city")).alias("city"),
        F.when(~has("MISSING"), c("email")).alias("email"),
        "phone",
        F.array_compact(F.array(*[F.when(F.coalesce(has(k) & effect[k], F.lit(False)), k) for k in CORRUPTIONS])).alias("corruptions"),
    )
    copies = dirty.select(F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("B")).alias(ID), F.lit("SRC_B").alias("source_id"), *ATTRIBUTES, F.concat(F.lit("E"), F.col("id").cast("string")).alias("true_entity"), "corruptions")
    return clean.union(copies)
