"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words in lower case (A-Z) and one end for each text. The root's distribution is the smoothed one of single symbols,
(c + 0.5) / (N + 0.5 (V + 1)). A context s is the symbols before the next one, within a text; n(s) is how often it stands in
training texts and n(s, w) how often w follows it there. Its distribution is smoothed towards that of its longest retained
proper suffix s', by PRIOR symbols' worth:

    p(w | s) = (n(s, w) + PRIOR p(w | s')) / (n(s) + PRIOR)

which sums to 1 over all symbols, seen or not, since that of the root does. Contexts of one and two symbols are tried always,
longer ones where their suffix is retained. A context is retained if for some symbol that follows it MIN_COUNT times or more the
probability differs by RATIO from the one that its suffix gives: the divergence test. Depth has no bound; it ends when no
context is left to try. No threshold depends on the size of the corpus, so the tree grows with it. Each symbol is scored at
the longest retained suffix of what came before it.

The tree is never in one place. Texts are packed into blocks, which stay where they are: a bucketed table that no level deals
out anew. For each level a block asks for its distinct (context, symbol) pairs with their counts and present scores. What is
asked of a context meets in its partition, which counts, tests and answers in the order asked, so rows are blocks by
partitions and never texts by partitions. A context that stands HOT times or more (and one in HOT_PART of all symbols: at most
HOT_PART contexts a level) is dealt out by its symbols as well: how often it stands is known from the level before, and which of
them are retained is a list so bounded. Positions whose context can't be retained deeper ask no more.

Defined results: a null or blank text is the end alone. A null id counts as the empty string in the split. Repeated rows are scored
alike and returned each. Texts are whole. An empty table gives no rows; without training texts every c is 0. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import arrow_batches, bucketed, let_go, written

MIN_COUNT = 4
RATIO = 1.5
PRIOR = 24.0
FOLDS, HELD_OUT = 5, 1
#: A partition answers for so many symbols, about; a block holds so many bytes of text, and a bucket of blocks so many.
TASK_SYMBOLS = 2_000_000
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
HOT, HOT_PART = TASK_SYMBOLS // 4, 100_000
END = K.mix(np.array([77], K.U))[0]
STEP = K.PLACE[0]

#: words: distinct symbols of the block; codes: each position's place among them; at: where texts begin.
READ = "block bigint, doc_id array<bigint>, train binary, at binary, words binary, codes binary, size bigint"
#: The same with ids in place of words, and how often each stands in training texts. Frequent symbols have low ids.
FIXED = "block bigint, doc_id array<bigint>, train binary, at binary, ids binary, counts binary, codes binary"
#: active: a bit for each position that asks at the next level, how many, their present scores and how often their contexts stand
#: (-1: not known); done: what the others of a text sum to. Before level 1 all of it follows from counts.
STATE = "block bigint, active binary, asking bigint, q binary, stands binary, done binary"
#: c: distinct contexts in order, how many rows each has and how often it stands (of hot ones: what rows of others sum to); of each row
#: w: symbol, n: count, q: score.
ASKED = "t int, block bigint, c binary, sizes binary, stands binary, w binary, n binary, q binary"
#: n: of each row asked; about: of each context asked, twice how often it stands, and one more if it is retained.
ANSWERED = "t int, block bigint, n binary, about binary, hot binary, total bigint, distinct bigint, words bigint"
#: Scores are asked about in steps of so much of a decimal place.
STEPS = 2048


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts end to end, and where each text's begin (and one more at the end)."""
    words, at = K.word_hashes(data, offsets)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def contexts(ids: np.ndarray, depth: int, where: np.ndarray, small: bool) -> np.ndarray:
    """A key for the depth symbols before each of the positions where, which all have so many in their text.

    One symbol is its id and two are both ids, which sort and compress well; more, or ids too large for that, are 56 bits of a hash.
    """
    if depth == 1:
        return ids[where - 1].astype(K.U)
    if depth == 2 and small:
        return (ids[where - 2].astype(K.U) << K.U(32)) | ids[where - 1].astype(K.U)
    h = np.full(len(where), K.U(depth))
    for j in range(depth, 0, -1):
        h = h * STEP + K.mix(ids[where - j].astype(K.U))
    return K.mix(h) >> K.U(8)


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each among them."""
    order = np.argsort(x)
    s = x[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], place


def _zip(x: np.ndarray) -> bytes:
    """Compressed, first bytes first: high bytes of small numbers are alike."""
    if not len(x):
        return b""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unzip(b, kind) -> np.ndarray:  # noqa: ANN001
    b, size = memoryview(b), np.dtype(kind).itemsize
    if not len(b):
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(v), kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class Block:
    """One row of the joined tables, arrays unpacked when asked for."""

    def __init__(self, row: dict) -> None:
        self.row, self.block = row, row["block"]
        self.codes, self.at = self.raw("codes", np.int32), self.raw("at", np.int64)

    def raw(self, name: str, kind) -> np.ndarray:  # noqa: ANN001
        return _unzip(self.row[name], kind)

    def train(self) -> np.ndarray:
        return np.repeat(self.raw("train", bool), np.diff(self.at))

    def before(self) -> np.ndarray:
        """How many symbols of its text stand before each position."""
        return np.arange(len(self.codes)) - np.repeat(self.at[:-1], np.diff(self.at))

    def by_text(self, where: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(self.at, where, "right") - 1, weights=q, minlength=len(self.at) - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        train = batch.column(2).to_numpy(zero_copy_only=False)
        begin, size, parts = 0, 0, []
        for _, j, data, offsets in K.chunks(batch.column(1)):
            parts.append(symbols(data, offsets))
            size += len(data)
            if size >= BLOCK_BYTES or j == batch.num_rows:
                sizes = np.concatenate([np.diff(at) for _, at in parts])
                words, codes = np.unique(np.concatenate([sym for sym, _ in parts]), return_inverse=True)
                arrays = (train[begin:j], np.r_[0, np.cumsum(sizes)].astype(np.int64), words, codes.astype(np.int32))
                yield _packed([(made, batch.column(0).slice(begin, j - begin).to_pylist(), *map(_zip, arrays), len(codes))], READ)
                made, begin, size, parts = made + 1, j, 0, []


def root_logs(counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.log10(counts + 0.5) - np.log10(total + 0.5 * (distinct + 1))


def smoothed(n: np.ndarray, stands: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Probability of symbols that follow n times a context that stands so often, given what its suffix makes of them."""
    return (n + PRIOR * q) / (stands + PRIOR)


class Pairs:
    """Distinct (context, symbol) of a block's active positions, dealt out to tasks: by context, of hot ones by symbol as well."""

    def __init__(self, b: Block, depth: int, tasks: int, total: int, distinct: int, hot: int, small: bool) -> None:
        ids, counts = b.raw("ids", np.int64), b.raw("counts", np.int64)
        if depth == 1:
            self.active = np.flatnonzero((b.before() > 0) & np.r_[False, counts[b.codes[:-1]] >= MIN_COUNT])
            w = b.codes[self.active].astype(np.int64)
            self.q, stands = root_logs(counts, total, distinct)[w], counts[b.codes[self.active - 1]]
        else:
            self.active = np.flatnonzero(np.unpackbits(b.raw("active", np.uint8)))
            w = b.codes[self.active].astype(np.int64)
            self.q, stands = b.raw("q", np.float32).astype(float), b.raw("stands", np.int32).astype(np.int64)
        c, at = ranked(contexts(ids[b.codes], depth, self.active, small))
        pair, place = ranked(at * len(ids) + w)
        first = np.zeros(len(pair), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        at, w = pair // max(len(ids), 1), ids[pair % max(len(ids), 1)]
        key = np.where(stands[first] >= hot, K.mix(c[at] * STEP + w.astype(K.U)), K.mix(c[at]))
        task = ((key >> K.U(20)) % K.U(tasks)).astype(np.uint16 if tasks < 1 << 16 else np.int64)
        order = np.argsort(task, kind="stable")
        #: each active position's pair, and of each pair its task, context, symbol, one position, and how often the context stands
        self.place = np.empty(len(pair), np.int64)
        self.place[order] = np.arange(len(pair))
        self.place = self.place[place]
        self.task, self.c, self.w, self.first = task[order], c[at][order], w[order], first[order]
        self.stands = stands[self.first]
        self.edge = np.r_[True, (self.c[1:] != self.c[:-1]) | (self.task[1:] != self.task[:-1])] if len(pair) else np.zeros(0, bool)

    def counted(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=train[self.active], minlength=len(self.first)).astype(np.int32)


def _parts(task: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(task, from, to) of each run of a sorted array."""
    cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True]) if len(task) else np.zeros(1, int)
    yield from zip(task[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _word_tasks(words: np.ndarray, tasks: int) -> np.ndarray:
    return ((words >> K.U(20)) % K.U(tasks)).astype(np.int64)


def _ask_words(tasks: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            words = b.raw("words", K.U)
            n = np.bincount(b.codes, weights=b.train(), minlength=len(words)).astype(np.int32)
            task = _word_tasks(words, tasks)
            order = np.argsort(task, kind="stable")
            for t, i, j in _parts(task[order]):
                mine = order[i:j]
                yield _packed([(t, b.block, _zip(words[mine]), b"", b"", b"", _zip(n[mine]), b"")], ASKED)

    return run


def _ask(depth: int, tasks: int, total: int, distinct: int, hot: int, small: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            p = Pairs(b, depth, tasks, total, distinct, hot, small)
            n, q = p.counted(b.train()), np.round(p.q[p.first] * STEPS).astype(np.int16)
            starts = np.flatnonzero(p.edge)
            for t, i, j in _parts(p.task):
                heads = starts[np.searchsorted(starts, i) : np.searchsorted(starts, j)]
                arrays = (np.diff(p.c[heads], prepend=K.U(0)), np.diff(np.r_[heads, j]).astype(np.int32), np.where(p.stands[heads] >= hot, p.stands[heads], -1), p.w[i:j], n[i:j], q[i:j])
                yield _packed([(t, b.block, *map(_zip, arrays))], ASKED)

    return run


def judged(c: np.ndarray, w: np.ndarray, n: np.ndarray, q: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (context, symbol) rows, with all rows of each pair: counts, how often contexts stand, whether one of these symbols retains it."""
    every, at = ranked(c)
    words, place = ranked(w)
    pair, row = ranked(at * len(words) + place)
    ctx = pair // len(words)
    n = np.bincount(row, weights=n).astype(np.int64)
    known, was = np.empty(len(every), np.int64), np.empty(len(pair))
    known[at], was[row] = stands, 10.0 ** (q.astype(float) / STEPS)
    stands = np.where(known >= 0, known, np.bincount(ctx, weights=n).astype(np.int64))
    p = smoothed(n, stands[ctx], was)
    retained = np.bincount(ctx, weights=(n >= MIN_COUNT) & ((p >= RATIO * was) | (was >= RATIO * p))) > 0
    return n[row], stands[at], retained[at]


def _counts(table: pa.Table) -> pa.Table:
    """Level 0: counts and ranks of the partition's words, and in its first row how many training symbols and distinct ones it has."""
    c, n = ([_unzip(v.as_buffer(), k) for v in table[name]] for name, k in (("c", K.U), ("n", np.int32)))
    every, place = ranked(np.concatenate(c))
    count = np.bincount(place, weights=np.concatenate(n), minlength=len(every)).astype(np.int64)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(every))
    total, distinct = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    total[0], distinct[0] = count.sum(), (count > 0).sum()
    cuts = np.cumsum([len(x) for x in c])[:-1]
    zipped = [pa.array([_zip(x) for x in np.split(v[place], cuts)], pa.binary()) for v in (count, rank)]
    return pa.table({"t": table["t"], "block": table["block"], "n": zipped[0], "about": zipped[1], "hot": pa.array([b""] * len(c), pa.binary()), "total": total, "distinct": distinct, "words": np.full(len(c), len(every))})


def _answer(depth: int, hot: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        column = lambda name, kind: [_unzip(v.as_buffer(), kind) for v in table[name]]
        parts, heads, sizes = column("n", np.int32), [np.cumsum(v) for v in column("c", K.U)], np.concatenate(column("sizes", np.int32))
        c, known = (np.repeat(np.concatenate(v), sizes) for v in (heads, column("stands", np.int64)))
        n, stands, retained = judged(c, np.concatenate(column("w", np.int64)), np.concatenate(parts), np.concatenate(column("q", np.int16)), known)
        begins = np.cumsum(sizes) - sizes
        about = (stands * 2 + retained)[begins]
        listed = np.unique(c[begins][(known >= hot)[begins] & retained[begins]])
        zipped = [pa.array([_zip(x) for x in np.split(v, np.cumsum([len(x) for x in of])[:-1])], pa.binary()) for v, of in ((n.astype(np.int32), parts), (about, heads))]
        none = np.zeros(len(parts), np.int64)
        return pa.table({"t": table["t"], "block": table["block"], "n": zipped[0], "about": zipped[1], "hot": pa.array([_zip(listed)] + [b""] * (len(parts) - 1), pa.binary()), "total": none, "distinct": none, "words": none})

    return run


def _answers(row: dict, name: str, kind) -> np.ndarray:  # noqa: ANN001
    """Answers of all tasks, in their order."""
    found = [_unzip(a[name], kind) for a in sorted(row["answers"] or [], key=lambda a: a["t"])]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _counted(tasks: int):  # noqa: ANN202
    """Takes in the counts: symbols get ids that are low where they are frequent, and codes in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            task = _word_tasks(b.raw("words", K.U), tasks)
            asked = np.argsort(task, kind="stable")
            counts, ids = np.zeros(len(task), np.int64), np.zeros(len(task), np.int64)
            counts[asked] = _answers(b.row, "n", np.int64)
            ids[asked] = _answers(b.row, "about", np.int64) * tasks + task[asked]
            order = np.argsort(ids)
            code = np.empty(len(ids), np.int32)
            code[order] = np.arange(len(ids))
            yield _packed([(b.block, b.row["doc_id"], b.row["train"], b.row["at"], *map(_zip, (ids[order], counts[order], code[b.codes])))], FIXED)

    return run


def _deeper(depth: int, tasks: int, total: int, distinct: int, hot: int, small: bool, listed: np.ndarray):  # noqa: ANN202
    """Takes in the answers of a level, and keeps active what can have a longer context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            p = Pairs(b, depth, tasks, total, distinct, hot, small)
            n, run_of = _answers(b.row, "n", np.int32).astype(np.int64), np.cumsum(p.edge) - 1
            about = _answers(b.row, "about", np.int64)[run_of]
            retained = (about & 1 > 0) | ((p.stands >= hot) & np.isin(p.c, listed))
            n, stands, retained = n[p.place], (about >> 1)[p.place], retained[p.place]
            q = np.where(retained, np.log10(smoothed(n, stands, 10.0**p.q)), p.q)
            # the longer context is the position before, with its own context: where that was asked for, its count is known
            longer = np.full(len(b.codes) + 1, -1, np.int64)
            longer[p.active + 1] = n
            longer = longer[p.active]
            known = longer >= MIN_COUNT if depth == 1 else (longer >= MIN_COUNT) | (longer < 0)
            go = (retained | (depth == 1)) & (b.before()[p.active] > depth) & known
            if depth == 1:
                others = np.ones(len(b.codes), bool)
                others[p.active] = False
                done = b.by_text(np.flatnonzero(others), root_logs(b.raw("counts", np.int64), total, distinct)[b.codes[others]])
            else:
                done = b.raw("done", np.float64)
            bits = np.zeros(len(b.codes), bool)
            bits[p.active[go]] = True
            arrays = (np.packbits(bits) if go.any() else np.zeros(0, np.uint8), q[go].astype(np.float32), longer[go].astype(np.int32), done + b.by_text(p.active[~go], q[~go]))
            active, q, longer, done = map(_zip, arrays)
            yield _packed([(b.block, active, int(go.sum()), q, longer, done)], STATE)

    return run


def _results(total: int, distinct: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            counts = b.raw("counts", np.int64)
            known, base = (np.add.reduceat(v[b.codes], b.at[:-1]) for v in ((counts > 0).astype(np.int64), root_logs(counts, total, distinct)))
            columns = [pa.array(b.row["doc_id"], pa.int64()), *map(pa.array, (np.diff(b.at), known, base, b.raw("done", np.float64)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _joined(fixed: DataFrame, *others: DataFrame) -> DataFrame:
    """Blocks with what belongs to them. Both tables are bucketed alike, so only answers travel."""
    for df in others:
        fixed = fixed.join(df.hint("shuffle_hash"), "block", "left")
    return fixed


def _by_block(answers: DataFrame, buckets: int) -> DataFrame:
    # as many partitions as the blocks have buckets, or the planner deals out the blocks as well
    return answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("t", "n", "about")).alias("answers"))


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # few buckets, so that levels write few files
    buckets = 1 + (rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BUCKET_BYTES)
    read = rows.select("doc_id", "text", (rest != HELD_OUT).alias("train")).mapInArrow(_blocked, READ).repartition(buckets, "block")
    read = bucketed(read, "read", buckets, "block")
    with arrow_batches(docs.sparkSession, 2):  # rows are blocks
        tasks_for = lambda n: max(1, -(-n // TASK_SYMBOLS))
        asking = read.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        tasks = tasks_for(asking)
        answers = written(read.mapInArrow(_ask_words(tasks), ASKED).groupBy("t").applyInArrow(_counts, ANSWERED).hint("rebalance"), "answers")
        total, distinct, largest = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
        hot, small = max(HOT, total // HOT_PART), largest * tasks < 1 << 32
        fixed = bucketed(_joined(read, _by_block(answers, buckets)).mapInArrow(_counted(tasks), FIXED), "blocks", buckets, "block")
        let_go(read, answers)
        state: list[DataFrame] = []
        depth = 1
        while asking or depth == 1:
            tasks = tasks_for(asking)
            answers = written(_joined(fixed, *state).mapInArrow(_ask(depth, tasks, total, distinct, hot, small), ASKED).groupBy("t").applyInArrow(_answer(depth, hot), ANSWERED).hint("rebalance"), "answers")
            # at most HOT_PART contexts
            listed = [_unzip(r[0], K.U) for r in answers.where(F.octet_length("hot") > 0).select("hot").collect()]
            listed = np.unique(np.concatenate(listed)) if listed else np.zeros(0, K.U)
            deeper = _deeper(depth, tasks, total, distinct, hot, small, listed)
            before, state = state, [bucketed(_joined(fixed, *state, _by_block(answers, buckets)).mapInArrow(deeper, STATE), "state", buckets, "block")]
            let_go(answers, *before)
            asking = state[0].agg(F.coalesce(F.sum("asking"), F.lit(0))).first()[0]
            depth += 1
        out = _joined(fixed, *state).mapInArrow(_results(total, distinct), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
        out = written(out, "scores")
        let_go(fixed, *state)
    return out.select("doc_id", (rest == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return scored(table(spark, sf_dir, "documents"))
