"""Each corpus operator against plain Python on small, awkward tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, decontam, encoding, kernels, mixing, neardup, quality, repeats, sstable, suffixtree, tokencount, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choices("abcdeé", k=random.Random(i).randint(1, 7))) for i in range(900)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = prose(rng, 150)
    words = base.split()
    near = [" ".join(w if rng.random() > p else "x" + w for w in words) for p in (0.01, 0.02, 0.03, 0.06, 0.3)]
    passage = prose(rng, 70)
    texts = [None, "", " \n\t ", "one", "one two three", "One TWO three", base, base, *near, *[prose(rng, 90) for _ in range(12)], f"{prose(rng, 60)}\n{passage} {prose(rng, 40)}", f"{passage}\n\n{prose(rng, 80)}", "na " * 400, "line of text\n" * 30 + "### || $$ " * 40, prose(rng, 6000), "a <|endoftext|> b c  d\n\n e"]
    out = [(i, t, None if i % 5 == 0 else "en", [None, "s1", "s2", "é", "s1"][i % 5], i) for i, t in enumerate(texts)]
    return [*out, out[6], (None, texts[14], "en", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("n_words", F.lit("clash")).withColumn("d1", F.lit(1)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_word_hashes():
    import pyarrow as pa

    texts = ["A b  c", None, "", "c b A", "é\ta"]
    for _, _, data, offsets in kernels.chunks(pa.array(texts)):
        hashes, at = kernels.word_hashes(data, offsets)
        assert at.tolist() == [0, 3, 3, 3, 6, 8]
        assert hashes[0] == hashes[5] == hashes[7] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4


def test_quality(spark, docs, rows):
    def measure(text):
        text = text or ""
        w = WORD.findall(text)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)

    got = quality.ledger(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect(), [(r[0], *measure(r[1])) for r in rows])
    kept = {r["doc_id"] for r in quality.filtered(docs).select("doc_id").collect()}
    assert {6, 14, 15} <= kept and not kept & {0, 1, 2, 3, 4, 5, 27, 28, 30}
    a = {(r["policy"], r["rule"]): r for r in quality.ablations(got).collect()}
    few = sum(measure(r[1])[0] < 50 for r in rows)
    assert a["v1", "few_words"]["failing"] == few
    masks = [r["failed_rules"] for r in got.collect()]
    assert len(a) == sum(m.bit_count() for m in quality.POLICIES.values())
    for (policy, rule), r in a.items():
        m, b = quality.POLICIES[policy], quality.BITS[rule]
        assert (r["failing"], r["only_this"], r["kept_without"]) == (sum(x & b > 0 for x in masks), sum(x & m == b for x in masks), sum(x & m & ~b == 0 for x in masks))
    assert quality.filtered(docs).columns == docs.columns and quality.filtered(empty(spark)).count() == 0


def shingle_sets(rows, k):
    out = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def test_near_duplicates(spark, docs, rows):
    sets = shingle_sets(rows, 4)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = [(r[0], len(sets[i]), least.get(root(i)), least.get(root(i)) == r[0]) for i, r in enumerate(rows)]
    same(neardup.near_duplicates(docs, k=4).collect(), want)
    kept = neardup.deduplicated(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns and 6 in ids and 7 not in ids
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (6, 40, 3000):
        common, a, b = (np.unique(rng.integers(0, 1 << 63, m).astype(np.uint64)) for m in (8 * n, n, n))
        x, y = (neardup.signature(np.sort(np.concatenate((common, s)))) for s in (a, b))
        assert abs((x == y).mean() - 0.8) < 0.12


def test_small_sets_share_a_bucket():
    """Recall of the buckets at similarity 0.8 to 0.84, from 4 shingles on, where most bins are borrowed."""
    rng = np.random.default_rng(2)
    for common, n in ((4, 1), (5, 1), (9, 2), (16, 4), (80, 20)):
        met = 0
        for _ in range(300):
            x = np.unique(rng.integers(0, 1 << 63, common + n).astype(np.uint64))
            y = x[rng.permutation(len(x))[:common]]
            keys = neardup.band_keys(np.array([neardup.signature(np.sort(v)) for v in (x, y)]))
            met += bool((keys[0] == keys[1]).any())
        assert met == 300


def test_spanning_links_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for it in range(60):
        base = [draw(rng.integers(1, 60)) for _ in range(4)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) > rng.choice([0, 0.05, 0.1, 0.2])], draw(rng.integers(1, 5))]) for b in (base[rng.integers(0, 4)] for _ in range(25))]
        label, side = rng.integers(0, 25, 25), None if it % 2 else rng.integers(0, 2, 25)
        joined = lambda comp, a, b: [comp[a] if v == comp[b] else v for v in comp]
        got = want = label.tolist()
        for a, b in neardup.spanning(sets, label, side, 80):
            assert got[a] != got[b]
            got = joined(got, a, b)
        for a in range(25):
            for b in range(a):
                c = len(np.intersect1d(sets[a], sets[b]))
                if (side is None or side[a] != side[b]) and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    want = joined(want, a, b)
        assert [got.index(v) for v in got] == [want.index(v) for v in want]


def test_deduplicated_has_one_row_of_each_group_whatever_ids_and_names(spark):
    rng = random.Random(8)
    text = prose(rng, 60)
    other = prose(rng, 60)
    rows = [(None, text, "a"), (None, text + " end", "b"), (None, text, "a"), (4, other, "c"), (4, other, "c"), (5, other + " x", "d"), (None, "", "e"), (None, None, "f")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, _id string").withColumns({c: F.lit(1) for c in ("_h", "id", "x", "row", "h", "uid", "d1", "label", "g", "kept", "n")}).repartition(2)
    out = neardup.deduplicated(table)
    assert out.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["_id"]) for r in out.collect()) in ([(0, v), (0, "e"), (0, "f"), (4, "c")] for v in "ab") or sorted((r["doc_id"] or 0, r["_id"]) for r in out.collect()) == [(0, "b"), (0, "e"), (0, "f"), (4, "c")]


def test_near_duplicate_tables_of_few_rows_are_few_files(spark, docs, monkeypatch):
    """Each file costs an executor processes, so their number must not follow that of the shuffle partitions."""
    files, plain = collections.defaultdict(list), neardup.written

    def counted(df, name, *args, **options):
        out = plain(df, name, *args, **options)
        files[name].append(len(out.inputFiles()))
        return out

    want = sorted(map(str, neardup.deduplicated(docs).collect()))
    monkeypatch.setattr(neardup, "written", counted)
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(str, neardup.deduplicated(docs).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert {"met", "nodes", "members", "reps", "hubs", "links", "tagged", "more", "kept", "each"} <= set(files)
    assert {k: n for k, n in files.items() if k not in ("signed", "sets") and max(n) > 1} == {}


def test_residual_blocks_find_links_that_no_star_has(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    copies = []
    for i in range(14):  # near to one another in pairs only
        w = list(base)
        for p in rng.sample(range(120), 9):
            w[p] = f"v{i // 2}_{p}"
        w[rng.randrange(120)] = f"u{i}"
        copies.append(" ".join(w))
    table = [(i, t, "en", "s", 0) for i, t in enumerate(copies)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(table, COLUMNS), k=2).collect()}
    sets = shingle_sets(table, 2)
    for i in range(14):
        for j in range(14):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert got[i] == got[j]


def test_blocks_hold_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    flips, begins = set(decontam.FLIPS), np.cumsum((0, *decontam.WIDTHS))
    assert begins[-1] == 64
    for _ in range(2000):
        x = 0
        for b in rng.permutation(64)[: rng.integers(0, decontam.RADIUS + 1)]:
            x |= 1 << int(b)
        assert any((x >> int(a)) & ((1 << w) - 1) in flips for a, w in zip(begins, decontam.WIDTHS, strict=False))


def test_fingerprints_of_similar_texts_are_within_the_radius():
    """Recall of the index at similarity 0.8 to 0.88, from 12 to 196 shingles."""
    rng = np.random.default_rng(0)
    bits = lambda h: 2 * ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) > len(h)
    missed = 0
    for n in (12, 16, 26, 36, 56, 96, 196):
        common = int(np.ceil(0.8 / 1.8 * 2 * n - 1e-9))
        for _ in range(1000):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.r_[a[:common], rng.integers(0, 2**64, n - common, dtype=np.uint64)]
            missed += (bits(a) != bits(b)).sum() > decontam.RADIUS
    assert missed <= 7  # one in a thousand


def test_decontamination(spark, docs):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (20, 33, 59)] + ["tiny item", None, "  "]
    w = items[2].split()
    w[30] = "changed"
    planted = [(100, f"{prose(rng, 30)} {items[0].upper()} {prose(rng, 9)}", "en", "s", 0), (101, items[1], "en", "s", 0), (102, f"{prose(rng, 10)} {' '.join(w)} {prose(rng, 10)}", "en", "s", 0), (103, " ".join(items[1].split()[:15] + prose(rng, 40).split()), "en", "s", 0), (104, "see the tiny item here", "en", "s", 0), (105, None, "en", "s", 0)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(planted, COLUMNS))
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(table, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (104, 3)}
    assert got[100, 0]["start_word"] == 30 and got[100, 0]["similarity"] == 1.0 and 0.8 <= got[102, 2]["similarity"] < 1
    left = [r["doc_id"] for r in decontam.clean(table, bench).collect()]
    assert not {100, 101, 102, 104} & set(left) and len(left) == table.count() - 4
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [40, 60, 120])
def test_decontamination_of_reordered_items(spark, n):
    """Halves swapped, or the last fifth moved to the front, amid a document."""
    rng = random.Random(n)
    w = [f"w{n}x{i}" for i in range(n)]
    texts = [w[n // 2 :] + w[: n // 2], w[-n // 5 :] + w[: -n // 5], w[: n // 2] + prose(rng, n // 2).split()]
    table = spark.createDataFrame([(i, f"{prose(rng, 70)} {' '.join(t)} {prose(rng, 80)}", "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    bench = spark.createDataFrame([(0, " ".join(w))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["start_word"], round(r["similarity"], 6)) for r in decontam.leaks(table, bench).collect()}
    m = n - 4
    assert got == {i: (70, round((m - 4) / (m + 4), 6)) for i in range(2)}


def test_chat_round_trip():
    for text in ("", "<|im_end|>", "<\\|x<\\\\|", "a<|im_start|>b\n<|", "\\<|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("us\ner\\n", "<|im_end|>\n"), ("assistant", "<|im_end|><|im_start|>assistant ok"), ("", "")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == [turns[1][1]]


def test_chat_events(spark):
    log = [(1, 0, 0, 0, "message", "user", "Hi"), (1, 1, 1, 0, "message", "assistant", ""), (1, 1, 1, 1, "delta", None, "bad"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "go"), (1, 1, 1, 4, "delta", None, "od"), (1, 0, 0, 9, "edit", None, "Hello"), (1, 2, 2, 0, "message", "user", "gone"), (1, 2, 2, 1, "remove", None, None), (2, None, 3, 0, "message", None, None)]
    events = spark.createDataFrame(log, "conv_id bigint, turn bigint, msg bigint, seq bigint, kind string, role string, text string")
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.formatted(events).collect()}
    assert got == {1: [("user", "Hello"), ("assistant", "good")], 2: [("", "")]}
    assert chat.formatted(events.limit(0)).count() == 0


def test_suffix_tree(spark, docs, rows):
    got = suffixtree.scored(docs).collect()
    tokens = [(r[0], WORD.findall((r[1] or "").translate(LOWER)) + [None]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted(((i is not None, i or 0), held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for i, t in tokens)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert suffixtree.scored(empty(spark)).count() == 0


class PlainTree:
    """The tree as its docstring gives it, by tuples of words, without blocks, hashes, levels of tasks or logarithms."""

    def __init__(self, train):
        self.count = collections.Counter(w for t in train for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.follow, self.depth = {}, 0
        tried = None
        while tried is None or tried or self.depth < 3:
            self.depth += 1
            tried = collections.defaultdict(collections.Counter)
            for t in train:
                for p in range(self.depth, len(t)):
                    if self.depth <= 2 or t[p - self.depth + 1 : p] in self.follow:
                        tried[t[p - self.depth : p]][t[p]] += 1
            self.follow |= {c: f for c, f in tried.items() if self.diverges(c, f)}

    def diverges(self, c, f):
        pairs = [(self.mixed(f, w, self.p(c[1:], w)), self.p(c[1:], w)) for w, m in f.items() if m >= suffixtree.MIN_COUNT]
        return any(p >= suffixtree.RATIO * q or q >= suffixtree.RATIO * p for p, q in pairs)

    @staticmethod
    def mixed(f, w, q):
        return (f[w] + suffixtree.PRIOR * q) / (sum(f.values()) + suffixtree.PRIOR)

    def p(self, history, w):
        """From the root to the longest retained suffix, each smoothed towards the one before."""
        q = (self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        for d in range(1, min(len(history), self.depth) + 1):
            f = self.follow.get(tuple(history[-d:]))
            q = q if f is None else self.mixed(f, w, q)
            if f is None and d >= 2:
                break
        return q

    def score(self, t):
        return sum(np.log10(self.p(t[max(0, p - self.depth) : p], w)) for p, w in enumerate(t))


def plain_suffix_tree(tokens, held):
    tree = PlainTree([t for t, h in zip(tokens, held, strict=True) if not h])
    return tree.depth, [tree.score(t) if len(t) < 10_000 else None for t in tokens]


def test_suffix_tree_keeps_rare_symbols_and_grows_deep(spark, monkeypatch):
    """Symbols of less than 1 in 20 at a context are kept, and contexts of three symbols are tried; blocks and tasks change nothing."""
    rng = random.Random(4)
    texts = [f"{rng.choice('ab')} {' '.join(rng.choices('xyz', k=2))} hub w{rng.randrange(40)} end" for _ in range(600)]
    texts = [t.replace("hub w", f"hub {t[0]}w") if t[2] == "x" else t for t in texts]
    texts += ["one two three four"] * 7 + [""]
    tokens = [(*t.split(), None) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    depth, want = plain_suffix_tree(tokens, held)
    assert depth > 3
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    monkeypatch.setattr(suffixtree, "TASK_SYMBOLS", 900)
    got = {r["doc_id"]: r["score"] for r in suffixtree.scored(table).collect()}
    assert len(got) == len(texts) and all(abs(got[i] - want[i]) < 1e-4 for i in got)


def test_suffix_tree_thresholds_are_alike_at_every_size(spark):
    """A context that stands 6 times is in the tree of 700,000 symbols."""
    texts = [f"red green blue{i}" for i in range(2)] + ["some rare phrase here"] * 8 + ["one", "na " * 700_000]
    tokens = [(*t.split(), None) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    assert not held[-1] and 4 <= sum(not h for h in held[2:10])
    _, want = plain_suffix_tree(tokens, held)
    rows = suffixtree.scored(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)).collect()
    got, base = ({r["doc_id"]: r[c] for r in rows} for c in ("score", "base_score"))
    assert all(abs(got[i] - want[i]) < 1e-3 for i in range(10)) and got[5] > base[5] / 3


def repetitive(rng, n):
    """Texts in which contexts of one to five words tell something, so that every level is used."""
    phrases = [rng.choices("abcdefgh", k=rng.randint(2, 7)) for _ in range(12)]
    return [" ".join(sum((rng.choice(phrases) for _ in range(rng.randint(0, 9))), [])) for _ in range(n)]


@pytest.mark.parametrize("hot", [5, 10**9])
def test_suffix_tree_scores_are_those_of_the_plain_tree(spark, monkeypatch, hot):
    """All rows; with contexts dealt out by symbol and without; over several blocks and tasks."""
    texts = repetitive(random.Random(9), 300)
    tokens = [(*t.split(), None) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    depth, want = plain_suffix_tree(tokens, held)
    assert depth > 4
    monkeypatch.setattr(suffixtree, "TASK_SYMBOLS", 700)
    monkeypatch.setattr(suffixtree, "HOT", hot)
    got = suffixtree.scored(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(4)).collect()
    assert len(got) == len(texts) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-4 for r in got)


def test_suffix_tree_is_a_distribution():
    """After every history the probabilities of all symbols seen and of one unseen sum to 1."""
    texts = [(*t.split(), None) for t in repetitive(random.Random(5), 200)]
    tree = PlainTree(texts)
    assert any(len(c) > 2 for c in tree.follow)
    for history in [t[:p] for t in texts[:20] for p in range(len(t))] + [("zz", "a"), ("zz",)]:
        assert abs(sum(tree.p(history, w) for w in tree.count) + tree.p(history, "never seen") - 1) < 1e-9


def test_warc(spark, monkeypatch):
    pages = [(1, "http://a/é b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\n", None), (4, "u", ""), (5, "u", "é" * 5000), (2, None, "<p>x</p>"), (None, "n", "only"), (None, "n", "<p>x</p>")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    got = warc.read_records(warc.write_archives(table)).collect()
    first = {"<p>x</p>": 1, "": 3, "é" * 5000: 5, "only": None}
    want = []
    for i, _, h in pages:
        h = h or ""
        f = first[h]
        want.append((i, len(h.encode()), warc.digest_of(h.encode()), "response" if i == f else "revisit", None if i == f else f))
    same([r[:5] for r in got], want)
    assert warc.read_records(warc.write_archives(table.limit(0))).count() == 0
    files = warc.stored(warc.write_archives(table))  # by ranges of files
    assert files.first()["file"].endswith(".zip")
    same([r[:5] for r in warc.read_records(files).collect()], want)
    assert warc.read_records(warc.stored(warc.write_archives(table.limit(0)))).count() == 0


def test_zip64_directory(monkeypatch):
    recs = [(i, warc.record(i, "u", b"x" * i, None, False)) for i in range(9)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 8)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = warc.archive(recs)
    assert warc.END64 in data
    assert list(warc.records(lambda at, n: data[at : at + n], len(data))) == recs
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("records.warc", "a" * 99)
    raw = packed.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warc.data_at(lambda at, n: raw[at : at + n], warc.members(lambda at, n: raw[at : at + n], len(raw))[0])
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.members(lambda at, n: b"x" * n, 40)


def test_encoder_is_the_library():
    import pyarrow as pa

    texts = ["", None, " a  b\n\nc \t d\r\n", "it's 3x, <|endoftext|>!", "a b   c", "\n", "  ", "ééé ça", "x" * 50, "<|endoftext|>"]
    for plain in (False, True):
        enc = encoding.Encoder(encoding.default_vocabulary(), plain)
        for _, _, data, offsets in kernels.chunks(pa.array(texts)):
            ids, at = enc.encode(data, offsets)
            assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [enc.lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts(spark, docs, rows, tmp_path):
    enc = encoding.Encoder(encoding.default_vocabulary(), plain=True)
    want = sorted(len(enc.lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    for size in (7, 64, 1 << 20):  # block borders change nothing
        blocks = tokencount.write_flat(docs, block_ids=size)
        got = tokencount.scan(blocks).collect()
        assert sorted(r["n_tokens"] for r in got) == want and all(r["closed"] for r in got)
    assert tokencount.scan(tokencount.write_flat(empty(spark))).count() == 0
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(r[0], len(enc.lib.encode(r[1] or "", add_special_tokens=False).ids), True) for r in rows]
    same(tokencount.query(spark, str(tmp_path)).select("doc_id", "n_tokens", "closed").collect(), pairs)
    torn = spark.createDataFrame([(0, 0, bytearray(np.array([1, 9, 2, 3], "<u2").tobytes())), (0, 1, bytearray(np.array([4, 4], "<u2").tobytes()))], "file_id bigint, block int, ids binary")
    same([tuple(r) for r in tokencount.scan(torn, end_id=9).collect()], [(0, 0, 0, 1, True), (0, 1, 2, 4, False)])


def test_mixing(spark, docs, rows):
    got = mixing.mixed(docs).collect()
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level_lo, level_hi = 0.0, 1e9
    for _ in range(200):
        mid = (level_lo + level_hi) / 2
        if sum(min(mid * weight[s], 2 * size[s]) for s in names) < 1.5 * sum(size.values()):
            level_lo = mid
        else:
            level_hi = mid
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == size[s] and abs(mine[0]["target"] - min(level_lo * weight[s], 2 * size[s])) < 1e-3
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    again = mixing.mixed(docs.repartition(5))
    same([tuple(r) for r in again.collect()], [tuple(r) for r in got])
    assert mixing.mixed(empty(spark)).count() == 0
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_token_shards(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    enc = encoding.Encoder(encoding.default_vocabulary())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for r in order:
        ids = [*enc.lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    shards = sstable.stored(docs)
    same(sstable.read_documents(shards).collect(), want)
    for i in (0, 6, 12, None):
        assert sstable.lookup(shards, i) == [[*enc.lib.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in order if r[0] == i]
    assert sstable.lookup(shards, 10**9) == []
    assert sstable.read_documents(sstable.stored(empty(spark))).count() == 0
    with pytest.raises(ValueError, match="not a token shard"):
        sstable.Reader(b"x" * 80)


def test_shard_keys_sort_as_ids():
    ids = [None, -(1 << 63), -5, -1, 0, 3, 1 << 40, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


def plain_repeats(rows, length):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(b[i : i + length] for _, b in raws for i in range(len(b) - length + 1))
    want = []
    for i, b in raws:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        left = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        want.append((i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(left).hexdigest()))
    return want


@pytest.mark.parametrize("length", [200, 60])
def test_repeats(spark, docs, rows, length):
    got = repeats.without_repeats(docs, length=length, gram=16).collect()
    same(got, plain_repeats(rows, length))
    assert sum(r["n_removed"] for r in got) > 0 and repeats.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize(("block", "broadcast"), [(1, 0), (6, 10**6), (10**9, 10**6)])
def test_repeats_of_a_passage_that_many_texts_share(spark, monkeypatch, block, broadcast):
    """Borders of shared passages, copies, near copies, a text that repeats itself; triggers in one block and in many."""
    rng = random.Random(12)
    passages, base = [prose(rng, n) for n in (30, 50, 90)], prose(rng, 120)
    texts = [f"{prose(rng, rng.randrange(40))} {rng.choice(passages)} {prose(rng, rng.randrange(40))}" for _ in range(60)]
    texts += [base] * 5 + [base[:p] + "#" + base[p + 1 :] for p in range(50, 500, 45)] + ["ab " * 300, prose(rng, 20) * 3]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast)
    same(repeats.without_repeats(spark.createDataFrame(rows, COLUMNS).repartition(5), gram=24).collect(), plain_repeats(rows, 200))


def test_very_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(3)
    text = prose(rng, 3000)
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = kernels.word_hashes(data, offsets)[0]
    full = repeats.phrases(data, offsets, 200, 48)
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 500)
    assert (kernels.word_hashes(data, offsets)[0] == whole).all()
    text_, g, _, a, b = repeats.phrases(data, offsets, 200, 48)
    spread = lambda g, a, b: [(t, w) for t, x, y in zip(g.tolist(), a.tolist(), b.tolist(), strict=True) for w in range(x, y + 1)]
    assert not text_.any() and sorted(spread(g, a, b)) == sorted(spread(full[1], full[3], full[4]))


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, rows[16][1][:220])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert 6 in ids and not ids & {0, 1, 2, 3, 7, 16}
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def plain_pipeline(rows, items):
    """(doc_id, start, n_tokens, crc32) of the pipeline's documents, stage by stage in plain Python."""
    kept = []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + d for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        bad = len(w) < 50 or 100 * len(again) > 50 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 30 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or not 2 * len(w) <= chars <= 20 * len(w)
        if not bad:
            kept.append(r)
    sets, label = shingle_sets(kept, 5), list(range(len(kept)))
    for _ in kept:  # labels sink until they stand still
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    groups = collections.defaultdict(list)
    for x, r in zip(label, kept, strict=True):
        groups[x].append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]

    def leaks(text):
        w = text.lower().split()
        for item in items:
            t = item.lower().split()
            k = min(5, len(t))
            grams = lambda x: collections.Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))  # noqa: B023, E731
            for i in range(max(1, len(w) - len(t) + 1)):
                a, b = grams(w[i : i + len(t)]), grams(t)
                if 100 * (a & b).total() >= 80 * (a | b).total() > 0:
                    return True
        return False

    kept = [r for r in kept if not leaks(r[1])]
    sources = sorted({r[3] for r in kept}, key=lambda s: (s is None, s or ""))
    size = lambda r: len(WORD.findall(r[1]))
    total = {s: sum(size(r) for r in kept if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    goal, capped = 1.5 * sum(total.values()), set()
    while True:
        level = (goal - sum(2 * total[s] for s in capped)) / max(sum(weight[s] for s in sources if s not in capped), 1e-9)
        over = {s for s in sources if s not in capped and level * weight[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        target = 2 * total[s] if s in capped else level * weight[s]
        whole = int(target // total[s])
        rest, before = target - whole * total[s], 0
        place = lambda r: hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        for _, own in itertools.groupby(sorted((r for r in kept if r[3] == s), key=lambda r: (int(place(r)[:8], 16) % 4096, place(r))), key=lambda r: int(place(r)[:8], 16) % 4096):
            own = list(own)
            n, begun = sum(map(size, own)), before
            for r in own:
                edge = begun < rest < begun + n
                more = before + size(r) / 2 <= rest if edge else begun + n <= rest
                out += [r] * (whole + more)
                before += size(r)
    enc, at, want = encoding.Encoder(encoding.default_vocabulary()), 0, []
    for r in sorted(out, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*enc.lib.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want


def test_pipeline_gives_the_rows_of_the_plain_stages(spark, tmp_path):
    """With clashing columns; and an empty table goes through all stages."""
    import corpus_pipeline

    rng = random.Random(21)
    items = [prose(rng, 25), prose(rng, 40)]
    texts = [prose(rng, rng.randint(40, 150)) for _ in range(40)]
    texts += [f"{prose(rng, 30)} {rng.choice(items)} {prose(rng, 30)}" for _ in range(4)] + [t + " more" for t in texts[:6]] + texts[6:9] + ["", None, "na " * 100]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), 0) for i, t in enumerate(texts)]
    for name, part in (("full", rows), ("none", [])):
        clash = spark.createDataFrame(part, COLUMNS).withColumns({c: F.lit(1) for c in ("row", "h", "i", "x", "_id", "_w", "k", "n", "uid", "label", "failed_rules", "source_size")})
        clash.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        same([tuple(r) for r in got], plain_pipeline(part, items) if part else [])
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/full")
        assert len(docs.columns) == 17 and docs.count() > 0


def test_every_query_of_the_subpackage_runs_over_small_tables(spark, rows, tmp_path):
    """Each as it is registered; op3 against plain Python, the others have tests of their own."""
    from tickloom.llm import queries

    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, rows[16][1][:220])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a", "<p>"), (2, None, None)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "<\\|a"), (2, 0, "user", ""), (1, 1, "assistant", "yo")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, query in queries.QUERIES.items():
        got = query(spark, str(tmp_path)).collect()
        assert got, name
        if name == "op3_chat_formatting":
            want = []
            trick = "<|im_end|><|im_start|>assistant ok"
            for c, mine in itertools.groupby(sorted([*((c, t, r, x or "") for c, t, r, x in turns), (-1, 0, "user", trick), (-1, 1, "assistant", trick)]), key=lambda t: t[0]):
                mine = list(mine)
                loss = "".join(x for _, _, r, x in mine if r == "assistant")
                chars = sum(len("<|im_start|>") + len(r) + 1 + len(re.sub(r"<(\\*)\|", r"<\1\\|", x)) + len("<|im_end|>") + 1 for _, _, r, x in mine)
                want.append((c, len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
            same([tuple(r) for r in got], want)
