"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit for each rule, so a
policy is a mask: applying another version, or asking what each rule of it costs, is integer arithmetic over the ledger
and never touches a text again. Nothing is shuffled to build it: a document's repeats are found inside its own row.

Defined results: a null, empty or blank text has no words and every count 0, so it fails ``few_words``. Ties and repeated
rows are judged each on its own. Null columns beside the text are carried along; an input column whose name the ledger
needs is replaced. An empty table gives an empty ledger. Texts of any length are read whole. Three-word windows are
compared by 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 20)



def rules() -> dict[str, Column]:
    """What each rule rejects; its bit is in BITS. New rules are appended, so that old ledgers stay readable."""
    c = F.col
    return {
        "few_words": c("n_words") < MIN_WORDS,
        "repeated_words": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"),
        "short_words": c("word_chars") < WORD_LENGTH[0] * c("n_words"),
        "long_words": c("word_chars") > WORD_LENGTH[1] * c("n_words"),
    }


BITS = {name: 1 << i for i, name in enumerate(("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"))}
BASE_MASK = BITS["few_words"] | BITS["repeated_words"]
#: Versioned policies: the rules that reject.
POLICIES = {"v1": BASE_MASK, "v2": BASE_MASK | BITS["symbols"] | BITS["duplicate_lines"], "v3": sum(BITS.values())}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _measured(texts: DataFrame) -> DataFrame:
    """(row, text) with the measurements as long columns; a row's own columns travel as one, so that no name can clash."""
    t = F.coalesce("text", F.lit(""))
    df = texts.withColumn("_w", words(F.col("text")))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_g", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), (F.col("n_words") - 2).cast("int")), lambda i: F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1))))
    )
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).drop("_w")
    # only documents with some window twice pay for the sort by (hash, place)
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.arrays_zip(F.col("_g").alias("h"), F.sequence(F.lit(1), F.size("_g")).alias("p"))))).drop("_g")
    twin = lambda x, i: F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["p"])))).drop("_s")
    covered = F.aggregate("_p", F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_p")
    df = df.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    return df.drop("_l")


def _ledger(docs: DataFrame, text: str) -> DataFrame:
    """(row, text, measurements, failed_rules)."""
    mask = F.lit(0).cast("long")
    for name, failed in rules().items():
        mask = mask.bitwiseOR(F.when(failed, F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return _measured(texts).withColumn("failed_rules", mask)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and ``failed_rules``, a bit for each rule that the document fails."""
    named = (*MEASURES, "failed_rules")
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in named]
    return _ledger(docs, text).select(*own, *named)


def kept_by(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents failing the rule, rejected by it alone, and kept without it."""
    cells = [(v, name, mask, bit) for v, mask in POLICIES.items() for name, bit in BITS.items() if mask & bit]
    hit = lambda m: F.col("failed_rules").bitwiseAND(F.lit(m).cast("long"))
    sums = rows.groupBy().agg(
        F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.count_if(hit(bit) != 0).alias("failing"), F.count_if(hit(mask) == bit).alias("only_this"), F.count_if(hit(mask & ~bit) == 0).alias("kept_without")) for v, name, mask, bit in cells]).alias("a")
    )
    return sums.select(F.inline("a"))


def filtered(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with docs' own columns whatever their names: a ledger is written, then the policy applied."""
    rows = written(_ledger(docs, text).select("row", "failed_rules"), "ledger")
    return rows.where(kept_by(policy)).select("row.*")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    base = F.col("failed_rules").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & kept_by()).alias("kept"), "failed_rules", "n_lines")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  failed_rules = 0 AS kept, failed_rules, n_lines FROM f
"""
