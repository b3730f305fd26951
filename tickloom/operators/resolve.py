"""Symbols to ids: splitting, normalising, exact and fuzzy lookup, quotes, whole tickers, phantom ids.

Symbols are resolved once for each distinct spelling, however often they stand, and joined back by whoever needs them. Assets are
found by joins, near names by an inverted index (``similar_names``). Whole tickers are looked up over Arrow batches of distinct
spellings, as what to look for depends on what was found before: there the registry is a bounded table, whose rows go to every task
as a list, checked against MOST_ASSETS. String forms are Catalyst expressions.

A null or blank symbol resolves to nothing. Ties go by rank, then class, then id (exact), or by similarity, shorter name, class and id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import written

SEPARATORS = "[/_-]"
# Suffixes of business names and of venue symbols, quotes, classes, pinned tokens.
BUSINESS_SUFFIXES = ("corporation", "company", "inc", "corp", "ltd", "llc", "limited", "group", "cie")
LETTER_SUFFIXES = ("us", "m", "c", "z", "b", "r", "d", "i")
WORD_SUFFIXES = ("usx", "mini", "micro", "cash", "spot", "ecn", "zero")
SIGILS = "^.$#_"
DELIMITERS = "-_.$^#"
MAJOR_QUOTES = ("usdt", "usdc", "usd", "eur", "gbp", "jpy", "cad", "aud", "chf", "btc", "eth")
CRYPTO_QUOTES = ("usdt", "usdc", "btc", "eth")
CRYPTO_QUOTE_NAMES = ("tether", "usd coin", "bitcoin", "ethereum")
CLASSES = {"EQ": 0, "FX": 3, "CM": 4, "CR": 6, "IN": 9, "IP": 10}
CLASS_PINS = ("CFG", "CVX", "DASH", "FF", "LDO", "MET", "SKY", "SOLV", "SUI", "W")
CR_SEED = {"BTC": 2701, "WBTC": 19201, "cbBTC": 3901, "TBTC": 17901, "BTCB": 2401, "BBTC": 3201, "EURC": 6251, "QCAD": 21601, "AUDF": 21701, "BRLA": 21801, "JPYC": 21901, "KRW1": 22001, "ETH": 5801, "DAI": 4801}
FX_SEED = {"EUR": 1301, "CAD": 601, "AUD": 101, "BRL": 301, "JPY": 2001, "KRW": 4201}
#: A registry of more assets than this is refused: its rows go to every task (a few MB at this size).
MOST_ASSETS = 100_000
ASSET = "name string, aliases array<string>, class string, class_id int, asset_id int"
#: Nibble of a perpetual: not a published value, so it is a parameter.
PERP = 1


def seed_registry(spark) -> DataFrame:  # noqa: ANN001
    rows = [(n, [], "CR", 6, i) for n, i in CR_SEED.items()] + [(n, [], "FX", 3, i) for n, i in FX_SEED.items()]
    return spark.createDataFrame(rows, ASSET)


def _s(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_pair(symbol: Column | str) -> Column:
    """struct(base, quote), or null unless exactly one separator has text on both sides."""
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    p = F.split(s, SEPARATORS)
    return F.when((F.size(p) == 2) & (F.get(p, 0) != "") & (F.get(p, 1) != ""), F.struct(F.get(p, 0).alias("base"), F.get(p, 1).alias("quote")))


def to_slash(symbol: Column | str) -> Column:
    return F.replace(F.col(symbol) if isinstance(symbol, str) else symbol, F.lit("-"), F.lit("/"))


def normalized(name: Column | str) -> Column:
    """Trimmed, lower case, punctuation at the end, a leading "the" and one business suffix off, then only letters, digits, + and -."""
    n = F.regexp_replace(F.lower(F.trim(_s(name))), r"[!-*,./:-@\[-`{-~]+$", "")
    n = F.regexp_replace(F.regexp_replace(n, "^the ", ""), rf"^(.*?) ({'|'.join(BUSINESS_SUFFIXES)})$", "$1")
    return F.regexp_replace(n, r"[^\p{L}\p{N}+-]", "")


def stripped(symbol: Column | str) -> Column:
    """In lower case without a leading sigil; then twice a listed suffix after the last of a delimiter, else a word, else a delimiter at the end."""
    s = F.regexp_replace(F.lower(_s(symbol)), rf"^[{re.escape(SIGILS)}]", "")
    for _ in range(2):
        out = s
        # the first kind of delimiter whose last place has a listed suffix behind it decides, so the last kind is tried first here
        tail = F.when(F.length(s) > 1, F.regexp_replace(s, rf"[{re.escape(DELIMITERS)}]$", "")).otherwise(s)
        out = tail
        for w in reversed(WORD_SUFFIXES):
            out = F.when(F.endswith(s, F.lit(w)) & (F.length(s) > len(w)), F.substring(s, F.lit(1), F.length(s) - len(w))).otherwise(out)
        for d in reversed(DELIMITERS):
            q = re.escape(d)
            found = F.regexp_extract(s, rf"^(.*){q}({'|'.join(LETTER_SUFFIXES)})$", 2)
            out = F.when(found != "", F.regexp_extract(s, rf"^(.*){q}({'|'.join(LETTER_SUFFIXES)})$", 1)).otherwise(out)
        s = out
    return s


def is_perp(symbol: Column | str) -> Column:
    """Whatever the case of the suffix."""
    return F.endswith(F.upper(_s(symbol)), F.lit(":PERP"))


def without_perp(symbol: Column | str) -> Column:
    return F.regexp_replace(_s(symbol), "(?i):PERP$", "")


def fx6(symbol: Column | str) -> Column:
    """Six letters as two currencies."""
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.when(s.rlike("^[A-Za-z]{6}$"), F.struct(F.upper(F.substring(s, 1, 3)).alias("base"), F.upper(F.substring(s, 4, 3)).alias("quote")))


def fnv1a_64(text: Column | str) -> Column:
    """64-bit FNV-1a as a decimal, folded over bytes in wide decimals modulo 2**64, in generated code's terms."""
    s = F.col(text) if isinstance(text, str) else text
    hexed = F.hex(F.encode(s, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(s) - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    # hi and lo halves keep every product within 64 bits: prime = 2**40 + 0x1B3
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(a, b):  # noqa: ANN001, ANN202
        lo = a["lo"].bitwiseXOR(b)
        p = lo * 0x1B3
        hi = (a["hi"] * 0x1B3 + F.shiftright(p, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(hi.alias("hi"), p.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

    h = F.when(F.octet_length(s) == 0, start).otherwise(F.aggregate(octets, start, step))
    return (h["hi"].cast("decimal(20,0)") * 4294967296 + h["lo"]).cast("decimal(20,0)")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(hits, other, strict=True)) / 2) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def upper_bound(a: str, b: str) -> float:
    """What the similarity can't exceed: every letter of the shorter that the other has at all may match, and the common prefix is real."""
    if not a or not b:
        return float(a == b)
    m = min(len(a), len(b), sum(c in a for c in b))
    jaro = (m / len(a) + m / len(b) + 1) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def similarities(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds jw to distinct pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(jw=[jaro_winkler(x, y) for x, y in zip(pdf[a], pdf[b], strict=True)])

    return pairs.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", jw double")


def plain_normalized(name: str) -> str:
    n = name.strip(" ").lower()
    n = re.sub(r"[!-*,./:-@\[-`{-~]+$", "", n).removeprefix("the ")
    for suffix in BUSINESS_SUFFIXES:
        if n.endswith(f" {suffix}"):
            n = n[: -len(suffix) - 1]
            break
    return "".join(c for c in n if c.isalnum() or c in "+-")


def plain_stripped(symbol: str) -> str:
    s = symbol.lower()
    s = s[1:] if s[:1] and s[0] in SIGILS else s
    for _ in range(2):
        cut = next((s[: -len(x) - 1] for d in DELIMITERS for x in LETTER_SUFFIXES if s.endswith(d + x)), None)
        if cut is None:
            cut = next((s[: -len(w)] for w in WORD_SUFFIXES if s.endswith(w) and len(s) > len(w)), None)
        s = cut if cut is not None else s[:-1] if len(s) > 1 and s[-1] in DELIMITERS else s
    return s


class Registry:
    """A bounded registry as lookup tables: the best asset of each key in each class, and keys by length for fuzzy search."""

    def __init__(self, rows: list[tuple]) -> None:
        self.names: dict[str, list[tuple]] = {}
        self.exact: dict[tuple, tuple] = {}
        self.pins: set[str] = set()
        found: dict[tuple, tuple] = {}
        self.keys: list[tuple] = []
        for name, aliases, kind, class_id, asset_id in rows:
            asset = (name, kind, class_id, asset_id)
            spelled = [(plain_normalized(name), 0)] + [(plain_normalized(x), int(i > 0)) for i, x in enumerate(x for x in aliases or [] if x)]
            for key, rank in spelled:
                for c in (None, class_id):
                    order = (rank, class_id, asset_id)
                    if key and order < found.get((c, key), ((9, 0, 0),))[0]:
                        found[c, key] = (order, asset)
            self.keys += [(key, asset) for key in {k for k, _ in spelled}]
        self.exact = {k: v[1] for k, v in found.items()}
        self.pins = {t.lower() for t in CLASS_PINS if (CLASSES["CR"], t.lower()) in self.exact}

    def find(self, query: str, least: float, kind: int | None = None) -> tuple | None:
        """(asset, similarity): exact on the spelling, then on its stripped form, then the nearest name at least so near."""
        return self.spelled(query, kind) or self.nearest(query, least, kind)

    def spelled(self, query: str, kind: int | None = None) -> tuple | None:
        """The asset that is so spelled, as it stands or stripped."""
        if not query or not query.strip():
            return None
        for key in (plain_normalized(query), plain_normalized(plain_stripped(query))):
            if key and (kind, key) in self.exact:
                return self.exact[kind, key], 1.0
        return None

    def nearest(self, query: str, least: float, kind: int | None = None) -> tuple | None:
        """The asset whose name is nearest, at least so near."""
        if not query or not query.strip():
            return None
        near = plain_normalized(plain_stripped(query))
        best = None
        for key, asset in self.keys:
            if (kind is None or asset[2] == kind) and key and upper_bound(near, key) + 1e-9 >= least:
                jw = jaro_winkler(near, key)
                order = (-jw, len(asset[0]), asset[2], asset[3])
                if jw >= least and (best is None or order < best[0]):
                    best = (order, asset)
        return best and (best[1], -best[0][0])

    def quote(self, token: str) -> tuple | None:
        """Asset of a quote token: majors in their class, others as a fiat if they are one, else wherever they are."""
        if token in MAJOR_QUOTES:
            own = self.find(token, 0.95, CLASSES["CR" if token in CRYPTO_QUOTES else "FX"])
        else:
            own = self.find(token, 1.0, CLASSES["FX"])
        own = own or self.find(token, 0.95)
        return own and own[0]

    def split(self, symbol: str) -> tuple | None:
        """(quote asset, base text): at the last separator of a kind, else by a major at the end or start; two quotes are in written order."""
        low = symbol.lower()
        for d in "/_-":
            left, sep, right = low.rpartition(d)
            base, token = left.strip("/_-"), right.strip("/_-")
            if sep and base and token and (q := self.quote(token)):
                return q, base
        for major in MAJOR_QUOTES:
            if len(low) <= len(major):
                continue
            rest = low[: -len(major)].rstrip("/_.")
            if low.endswith(major) and rest and (q := self.quote(major)):
                return q, rest
            rest = low[len(major) :].lstrip("/_.")
            if low.startswith(major) and rest and (q := self.quote(major)):
                right = self.quote(rest)
                return (right, major) if right else (q, rest)
        return None

    def ticker(self, symbol: str) -> tuple | None:
        """(base, quote, similarity), or none for what can't be resolved: a quote without its base is none, a bare asset is against USD."""
        low = symbol.lower()
        if len(symbol) == 6 and symbol.isascii() and symbol.isalpha():
            legs = [self.find(x, 0.9, CLASSES["FX"]) for x in (symbol[:3], symbol[3:])]
            if all(legs):
                return legs[0][0], legs[1][0], 1.0
        clean = plain_stripped(symbol)
        pin = lambda token: CLASSES["CR"] if clean == low and token.strip().lower() in self.pins else None
        parts = self.split(clean)
        if parts is None:
            usd, own = self.find("usd", 0.95, CLASSES["FX"]), self.find(clean, 0.9, pin(clean))
            return (own[0], usd[0], own[1]) if own and usd else None
        quote, base = parts
        crypto = quote[0].lower() in CRYPTO_QUOTE_NAMES
        least = 0.95 if len(base) <= 4 else 0.9
        kinds = [CLASSES[c] for c in ("CR", "FX", "CM", "IP", "EQ")] if crypto else [pin(base)]
        # a spelling in any of the classes goes before a near name in an earlier one
        own = next((m for c in kinds if (m := self.spelled(base, c))), None) or next((m for c in kinds if (m := self.nearest(base, least, c))), None)
        return own and (own[0], quote, own[1])


def _rows(registry: DataFrame) -> list[tuple]:
    """The registry's rows; names without a list of aliases have none. A registry beyond its bound is an error."""
    aliases = F.col("aliases") if "aliases" in registry.columns else F.array().cast("array<string>")
    rows = registry.where("name IS NOT NULL").select("name", aliases, "class", "class_id", "asset_id").limit(MOST_ASSETS + 1).collect()
    if len(rows) > MOST_ASSETS:
        raise ValueError(f"a registry of more than {MOST_ASSETS} assets")
    return [tuple(r) for r in rows]


def _per_symbol(symbols: DataFrame, rows: list[tuple], schema: str, one) -> DataFrame:  # noqa: ANN001
    """one(registry, symbol) gives the columns behind symbol, or none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Registry(rows)
        for pdf in batches:
            found = [(s, one(known, s)) for s in pdf["symbol"]]
            yield pd.DataFrame([(s, *f) for s, f in found if f is not None], columns=names)

    names = ["symbol", *[c.split()[0] for c in schema.split(", ")]]
    return symbols.select("symbol").where("symbol IS NOT NULL").distinct().mapInPandas(run, f"symbol string, {schema}")


def _tokens(strings: DataFrame) -> DataFrame:
    """(s, n, c, occ): the letters of each distinct string of n letters, each with which of its kind it is, so that they are a set."""
    letters = strings.select("s", F.length("s").alias("n"), F.posexplode(F.regexp_extract_all("s", F.lit("(?s)."), F.lit(0))).alias("at", "c"))
    return letters.select("s", "n", "c", F.row_number().over(Window.partitionBy("s", "c").orderBy("at")).alias("occ"))


def _rarest_first(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds i: which token of its string it is, those that few keys have first."""
    t = tokens.join(counts, ["c", "occ"], "left")
    return t.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("keys", F.lit(0)), "c", "occ")) - 1).drop("keys")


def similar_names(queries: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(q, key, jw) of all distinct strings q of queries (q, need) and key of keys whose Jaro-Winkler similarity is need or more; need is at least least.

    A join on an inverted index, not a scan. With k common letters at the start (4 count at most) the similarity is
    J + k/10 (1 - J), so J must be j = (need - k/10) / (1 - k/10). J is at most (m/a + m/b + 1) / 3 for lengths a and b and m letters in
    common, so one length is 3j - 2 of the other or more, and m is o = (3j - 1) ab / (a + b) or more. Two sets of a and b letters with o in
    common share one of the first a - o + 1 and b - o + 1 of them, in any order that holds for all: the rarest come first. So pairs
    meet by (k, first k letters, b, letter), and what meets is compared in full. need is 0.7 or more, or pairs could have no letter in common.
    """
    if least < 0.7:
        raise ValueError(f"names are compared at similarities from 0.7 on, not {least}")
    q = queries.where("q <> ''").groupBy("q").agg(F.min("need").alias("need"))
    names = keys.select(F.col("key").alias("s")).where("s <> ''").distinct()
    index = _tokens(names)
    counts = index.groupBy("c", "occ").agg(F.count("*").alias("keys"))
    index, asked = _rarest_first(index, counts), _rarest_first(_tokens(q.select(F.col("q").alias("s"))), counts)
    starts = F.explode(F.sequence(F.lit(0), F.least(F.lit(4), F.col("n")))).alias("k")
    j = lambda need: (need - 0.1 * F.col("k")) / (1 - 0.1 * F.col("k"))
    common = lambda a, b: F.ceil((3 * F.col("j") - 1) * a * b / (a + b) - 1e-9)
    index = index.select("s", "n", "c", "occ", "i", starts).withColumn("j", j(F.lit(float(least)))).withColumn("r", F.greatest(3 * F.col("j") - 2, F.lit(0.1)))
    index = index.where(F.col("i") <= F.col("n") - common(F.col("n"), F.col("n") * F.col("r")))
    index = index.select(F.col("s").alias("key"), F.col("n").alias("b"), "c", "occ", F.col("i").alias("at"), "k", F.substring(F.col("s"), F.lit(1), F.col("k")).alias("start"))
    longest = index.agg(F.max("b")).first()[0] or 0
    asked = asked.join(q, F.col("s") == F.col("q")).select("q", "need", "n", "c", "occ", "i", starts).withColumn("j", j(F.col("need"))).withColumn("r", F.greatest(3 * F.col("j") - 2, F.lit(0.1)))
    lo, hi = F.greatest(F.ceil(F.col("n") * F.col("r") - 1e-9), F.lit(1)), F.least(F.floor(F.col("n") / F.col("r") + 1e-9), F.lit(longest))
    asked = asked.where(lo <= hi).withColumn("b", F.explode(F.sequence(lo.cast("int"), hi.cast("int")))).withColumn("o", common(F.col("n"), F.col("b")))
    asked = asked.where(F.col("i") <= F.col("n") - F.col("o")).select("q", "need", "c", "occ", "k", "b", "o", F.substring(F.col("q"), F.lit(1), F.col("k")).alias("start"))
    met = asked.join(index, ["k", "start", "b", "c", "occ"]).where(F.col("at") <= F.col("b") - F.col("o")).select("q", "need", "key").distinct()
    return similarities(met, "q", "key").where("jw >= need").select("q", "key", "jw")


def resolved(symbols: DataFrame, registry: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(symbol, name, class, asset_id, jw) of each distinct symbol that is an asset; short symbols (four letters) need 0.95.

    Exact on the spelling, then on its stripped form, then the nearest name at least so near: joins all three, for registries of
    any size. Names without a list of aliases have none.
    """

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(k1=pdf["symbol"].map(plain_normalized), k2=pdf["symbol"].map(lambda x: plain_normalized(plain_stripped(x))))

    s = symbols.select("symbol").where(F.trim("symbol") != "").distinct().mapInPandas(forms, "symbol string, k1 string, k2 string")
    spelled = _spelled(registry.where("name IS NOT NULL"))
    asset = F.struct("rank", "class_id", "asset_id", "name", "class")
    best = spelled.groupBy("key").agg(F.min(asset).alias("m"))
    found = s.join(best.select(F.col("key").alias("k1"), F.col("m").alias("m1")), "k1", "left").join(best.select(F.col("key").alias("k2"), F.col("m").alias("m2")), "k2", "left")
    found = written(found.withColumn("m", F.coalesce("m1", "m2")).select("symbol", "k2", "m"), "symbols")
    need = F.when(F.length("k2") <= 4, F.lit(max(0.95, threshold))).otherwise(F.lit(threshold))
    rest = found.where("m IS NULL AND k2 <> ''").select("symbol", "k2", need.alias("need"))
    near = similar_names(rest.select(F.col("k2").alias("q"), "need"), spelled, threshold).join(spelled, "key")
    nearest = near.groupBy("q").agg(F.min(F.struct((-F.col("jw")).alias("far"), F.length("name").alias("long"), "class_id", "asset_id", "name", "class")).alias("m"))
    fuzzy = rest.join(nearest, F.col("k2") == F.col("q")).select("symbol", "m.name", "m.class", "m.asset_id", (-F.col("m.far")).alias("jw"))
    return found.where("m IS NOT NULL").select("symbol", "m.name", "m.class", "m.asset_id", F.lit(1.0).alias("jw")).unionByName(fuzzy)


def resolved_tickers(symbols: DataFrame, registry: DataFrame, perp: int = PERP) -> DataFrame:
    """(symbol, ticker_id, base, quote, jw) of each distinct symbol that is a ticker: ``:PERP`` sets the instrument, six letters are two
    currencies, a crypto quote makes the base crypto (then a currency, a commodity, an index, a share), pinned tokens are crypto. The
    order of classes holds among exact spellings, then among near names."""

    def one(known: Registry, s: str) -> tuple | None:
        bare = re.sub("(?i):PERP$", "", s)
        m = known.ticker(bare)
        return m and (perp if bare != s else 0, m[0][2], m[0][3], m[1][2], m[1][3], m[0][0], m[1][0], m[2])

    kinds = "itype bigint, base_class bigint, base_id bigint, quote_class bigint, quote_id bigint, base string, quote string, jw double"
    rows = _per_symbol(symbols, _rows(registry), kinds, one)
    return rows.select("symbol", X.make_ticker(*[F.col(c) for c in ("itype", "base_class", "base_id", "quote_class", "quote_id")]).alias("ticker_id"), "base", "quote", "jw")


def ticker_ids(symbols: DataFrame, registry: DataFrame) -> DataFrame:
    """(symbol, ticker_id, phantom) of every distinct symbol: what can't be resolved has the 64-bit hash of its bytes, as a signed number."""
    s = symbols.select("symbol").where("symbol IS NOT NULL").distinct()
    r = resolved_tickers(s, registry).select("symbol", "ticker_id")
    h = fnv1a_64("symbol")
    signed = F.when(h > (1 << 63) - 1, h - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(h).cast("long")
    return s.join(r, "symbol", "left").select("symbol", F.coalesce("ticker_id", signed).alias("ticker_id"), F.col("ticker_id").isNull().alias("phantom"))


def named_tickers(tickers: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds base, quote and itype to (ticker_id, ...): upper-case names, or the id in hex and an empty quote where either leg is unknown.

    A row whose leg's id several assets share stands once for each of their names, so tickers should be distinct.
    """
    t = "ticker_id"
    a = registry.select(F.col("class_id").cast("long").alias("c"), F.col("asset_id").cast("long").alias("i"), F.upper("name").alias("name"))
    out = tickers
    for side, at in (("base", 56), ("quote", 36)):
        r = a.select(F.col("c").alias(f"_{side}_c"), F.col("i").alias(f"_{side}_i"), F.col("name").alias(f"_{side}"))
        out = out.join(r, (X.ticker_field(t, at, 4) == F.col(f"_{side}_c")) & (X.ticker_field(t, at - 16, 16) == F.col(f"_{side}_i")), "left")
    both = F.col("_base").isNotNull() & F.col("_quote").isNotNull()
    shown = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(t), 16, "0")))
    out = out.withColumn("base", F.when(both, F.col("_base")).otherwise(shown)).withColumn("quote", F.when(both, F.col("_quote")).otherwise("")).withColumn("itype", X.ticker_field(t, 60, 4))
    return out.drop("_base", "_quote", "_base_c", "_base_i", "_quote_c", "_quote_i")


def providers_named(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """Adds provider_name to rows by provider; An unknown id has no name."""
    p = providers.select(F.col("id").alias("_id"), F.col("name").alias("provider_name"))
    return rows.join(p, F.col("provider") == F.col("_id"), "left").drop("_id")


def _spelled(registry: DataFrame) -> DataFrame:
    """(key, rank, name, class, class_id, asset_id): every spelling of every asset, its name and first alias first."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in registry.columns else F.array().cast("array<string>")
    e = registry.select("name", "class", "class_id", "asset_id", F.posexplode(F.concat(F.array("name"), F.filter(aliases, lambda x: x != ""))).alias("i", "spelling"))
    return e.select(normalized("spelling").alias("key"), (F.col("i") > 1).cast("int").alias("rank"), "name", "class", "class_id", "asset_id").where("key <> ''").groupBy("key", "name", "class", "class_id", "asset_id").agg(F.min("rank").alias("rank"))


def collisions(registry: DataFrame) -> DataFrame:
    """Keys that more than one asset of a class has."""
    return _spelled(registry).groupBy("class", "key").agg(F.countDistinct("asset_id").alias("n")).where("n > 1")


def checked(registry: DataFrame) -> DataFrame:
    """The registry itself, or an error if two crypto assets share a key."""
    bad = [r["key"] for r in collisions(registry).where("class = 'CR'").limit(20).collect()]
    if bad:
        raise ValueError(f"crypto assets share the keys {', '.join(sorted(bad))}")
    return registry


def unpinned_clashes(symbols: DataFrame, registry: DataFrame, kind: str = "CR", pins: tuple[str, ...] = CLASS_PINS) -> DataFrame:
    """Symbols that an asset of the class has exactly, but that resolve to another class and aren't pinned: (symbol, class)."""
    spelled = _spelled(registry)
    top = spelled.groupBy("key").agg(F.min(F.struct("rank", "class_id", "asset_id", "class")).alias("best")).select("key", "best.class")
    own = spelled.where(F.col("class") == kind).select("key").distinct()
    s = symbols.select("symbol").distinct().withColumn("key", normalized("symbol")).where(~F.lower(F.trim("symbol")).isin([x.lower() for x in pins]))
    return s.join(own, "key", "left_semi").join(top, "key").where(F.col("class") != kind).select("symbol", "class")
