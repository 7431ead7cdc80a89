"""Exact Jaccard join on word shingles by a blocked sparse matrix product (operator 10).

Documents are rows and hashed n-grams are columns of an incidence matrix; documents with equal sets are one row. The matrix is
multiplied with its transpose a block of columns at a time, each block adding to the overlap counts of the pairs; what sizes
ask for and the columns still to come discard pairs between blocks, and the count after the last block alone decides a link (`_links`).
The product is taken under a mask, as the whole of it holds all pairs within every group. The mask comes from sizes alone, and no link can escape
it:

* a row keeps the `u + l` columns of least hash, u = n - ceil(t n) being what it can lack of a partner and
  l = ceil(n / 10): two partners have at least the lesser l in common among what both keep;
* columns with one row, then rows with fewer shared columns than that, go; of the rest a row leaves out the
  fullest, one less than it must share, so that passages which many texts quote mostly bring none together;
* a pair that meets in a kept column is left out if sizes differ too much, or if the rows' parity bitmaps differ in more
  bits than the sets may differ in elements (equal elements cancel out, so the bitmaps can't differ in more).

A first mask pairs the rows of a column with its middle, linear in the entries; a second one takes all pairs whose ends are not
linked yet, so that a family of n near copies costs about n products where its members are linked. Components are those of all
links.

Columns come sorted and are read a bounded number of entries at a time. A column of more than `TILE` rows is split: in the
first round into tiles with middles of their own, which then meet in the column; in the second every two tiles are one
group. Joins split the keys that very many rows hold.

Defined results: null and word-free texts have no shingle and link with nothing; texts of fewer words than a shingle are
one shingle; ids are integers; repeated rows of one id are one document if they are equal; a row with a null id links with
nothing and is its own component (null); an empty table gives an empty result; columns beside key and text are not read;
texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import components, crowded, materialize, skew_join, slices, tidied
from leadline.llm.shingles import batches_of_sets, digest, mix

U = np.uint64
#: Columns of each row, the fullest ones first, in which the first round looks for links.
SPANNED = 4
#: Ids that may be broadcast (8 bytes each).
FEW_IDS = 1_000_000
#: Blocks of columns: ranges of the leading bits of their hashes.
BLOCK_BITS = 1
BLOCKS = 1 << BLOCK_BITS
COUNTED_PAIRS = "u long, v long, need long, c long, ru long, rv long"
#: Entries of both sides whose products are counted at once.
ADDED = 1 << 19
#: Texts that a task tells apart to send the columns of each once.
SENT = 1 << 18
#: Rows of a column that one task compares at once.
TILE = 1 << 14
#: Entries of sorted columns that are read at once.
READ = 1 << 16
#: Rows of a column that are counted; beyond it they are no longer told apart by number.
COUNTED = 1 << 22
#: Bits of a parity bitmap by set size.
CLASSES = ((256, 512), (1024, 2048), (1 << 62, 8192))


def kept_columns(n: int, percent: int) -> int:
    lacks = n - -(-percent * n // 100)
    return min(n, lacks + max(1, -(-n // 10)))


def least_shared(n, percent: int):
    """Columns that a row of n must share with any partner: the partner may be smaller."""
    return F.greatest(F.lit(1), F.ceil(F.ceil(n * percent / 100) / 10))


def parity(h: np.ndarray) -> bytes:
    bits = next(b for most, b in CLASSES if len(h) <= most)
    odd = np.bincount((h >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _features(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for part, sets in batches_of_sets(b, 1, size):
                d = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())], [key, "n", "d1", "d2", "bits"])

    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run), f"`{key}` long, n long, d1 long, d2 long, bits binary")


def _columns(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(h, d1): the columns that each row keeps. Of equal sets a task sends those of one: copies cost no more than there are tasks."""

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for b in batches:
            for _, sets in batches_of_sets(b, 0, size):
                held, ids = [], []
                for s in sets:
                    d = digest(s)
                    if d not in sent and len(s):
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(d)
                        held.append(s[: kept_columns(len(s), percent)])
                        ids.append(d[0])
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in held]))], ["h", "d1"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run), "h long, d1 long")


def _shared(batches):
    """Of sorted columns (h, d1) those with two rows or more, without repeats, and their numbers of rows (at most COUNTED)."""
    held_h, held_d, done = np.empty(0, np.int64), np.empty(0, np.int64), None  # done: a column of COUNTED rows or more, partly given out

    def given(h, d, rows):
        for i in range(0, len(h), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (h, d, rows)], ["h", "d1", "rows"])

    def settle(h, d):
        """Whole columns."""
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(first, len(h)))
            size = np.where(h[first] == done, COUNTED, size)
            rows = np.repeat(size, np.diff(np.append(first, len(h))))
            yield from given(h[rows > 1], d[rows > 1], rows[rows > 1])

    for b in batches:
        h, d = np.concatenate([held_h, b.column(0).to_numpy()]), np.concatenate([held_d, b.column(1).to_numpy()])
        if not len(h):
            continue
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[new], d[new]
        last = int(np.searchsorted(h, h[-1]))
        yield from settle(h[:last], d[:last])
        held_h, held_d = h[last:], d[last:]
        if len(held_h) > COUNTED:  # all but the last row, against which the next one is compared
            done = held_h[0]
            yield from given(held_h[:-1], held_d[:-1], np.full(len(held_h) - 1, COUNTED))
            held_h, held_d = held_h[-1:], held_d[-1:]
    yield from settle(held_h, held_d)


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


class Bitmaps:
    """The rows' parity bitmaps by class, and the test of pairs with them."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.percent = n, percent
        widths = [b // 64 for _, b in CLASSES]
        self.kind = np.array([widths.index(len(b) // 8) for b in bits])
        self.place = np.zeros(len(bits), np.int64)
        self.maps = {}
        for k in range(len(CLASSES)):
            at = np.flatnonzero(self.kind == k)
            self.place[at] = np.arange(len(at))
            x = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), widths[k]) if len(at) else np.empty((0, widths[k]), np.uint64)
            for low in range(k + 1):
                self.maps[k, low] = _fold(x, widths[low])

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs whose sizes and bitmaps allow a link."""
        n, p = self.n, self.percent
        ok = 100 * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])
        # a set's difference from its partner has at most (100 - t) / (100 + t) of both sizes
        most = (100 - p) * (n[a] + n[b]) // (100 + p)
        for ka in range(len(CLASSES)):
            for kb in range(len(CLASSES)):
                m = np.flatnonzero(ok & (self.kind[a] == ka) & (self.kind[b] == kb))
                for j in range(0, len(m), 1 << 15):
                    q = m[j : j + (1 << 15)]
                    low = min(ka, kb)
                    x = self.maps[ka, low][self.place[a[q]]] ^ self.maps[kb, low][self.place[b[q]]]
                    ok[q] = np.bitwise_count(x).sum(1) <= most[q]
        return ok


def spanning_pairs(h: np.ndarray, row: np.ndarray, maps: Bitmaps, rounds: int = 12, middles: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Possible links that join the rows of a column: linear in the entries.

    In each column the row nearest to the bitwise majority of the bitmaps is paired with all rows that can link
    with it; those that are left look for a middle of their own, `rounds` times. (column, row) of the middles are added to `middles`.
    """
    order = np.lexsort((row, maps.kind[row], h))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (maps.kind[row[1:]] != maps.kind[row[:-1]])])) if len(h) else np.empty(0, np.int64)
    out = []
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(h)]):
        left = row[s:e]
        for _ in range(rounds):
            if len(left) < 2:
                break
            x = maps.maps[int(maps.kind[left[0]]), int(maps.kind[left[0]])][maps.place[left]]
            bits = np.unpackbits(x[:4096].view(np.uint8), axis=1)
            middle = np.packbits(bits.sum(0) * 2 > len(bits)).view(np.uint64)
            m = left[int(np.bitwise_count(x ^ middle).sum(1).argmin())]
            if middles is not None:
                middles.append((int(h[s]), m))
            rest = left[left != m]
            ok = maps.near(np.full(len(rest), m), rest)
            if ok.any():
                out.append((np.full(int(ok.sum()), m), rest[ok]))
            left = rest[~ok]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    return np.divmod(np.unique(np.minimum(a, b) * len(maps.n) + np.maximum(a, b)), len(maps.n))


def unlinked_pairs(h: np.ndarray, row: np.ndarray, maps: Bitmaps, group: np.ndarray, step: int = 1 << 20):
    """All pairs of rows of different groups that meet in some column and pass the bounds, a bounded number at a time.

    In a column the rows stand by group, and a row's partners are those after its group: rows of one group,
    however many, cost nothing. A pair can come again.
    """
    order = np.lexsort((row, group[row], h))
    h, row = h[order], row[order]
    g = group[row]
    n = len(h)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    after = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
    cols = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.repeat(np.append(cols[1:], n), np.diff(np.append(cols, n)))
    some = np.flatnonzero(last > after)
    counts = (last - after)[some]
    ends = np.cumsum(counts)
    at = 0
    while at < (int(ends[-1]) if len(ends) else 0):
        upto = min(at + step, int(ends[-1]))
        place = np.arange(at, upto)
        i = np.searchsorted(ends, place, side="right")
        a, b = row[some[i]], row[after[some[i]] + place - (ends[i] - counts[i])]
        code = np.unique(np.minimum(a, b) * len(maps.n) + np.maximum(a, b))
        a, b = np.divmod(code, len(maps.n))
        ok = maps.near(a, b)
        if ok.any():
            yield a[ok], b[ok]
        at = upto


def _columns_of(batches, width: int, most: int = READ):
    """Whole groups of sorted columns, `most` entries or more at a time; a group is told by the first `width` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) >= most:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            names = [whole.column(k).to_numpy() for k in range(width)]
            cut = max(np.flatnonzero(x[:-1] != x[1:])[-1] + 1 if (x[:-1] != x[1:]).any() else 0 for x in names)
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)] if cut < len(whole) else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows_of(b: pa.RecordBatch, percent: int):
    """(columns, rows, bitmaps, row digests, groups) of entries (h, ..., d1, n, g, bits)."""
    named = b.schema.names
    d, at, row = np.unique(b.column(named.index("d1")).to_numpy(), return_index=True, return_inverse=True)
    bits = b.column(named.index("bits")).take(pa.array(at)).to_pylist()
    return b.column(0).to_numpy(), row, Bitmaps(b.column(named.index("n")).to_numpy()[at], bits, percent), d, b.column(named.index("g")).to_numpy()[at]


def _pairs_out(d, a, b):
    for i in range(0, len(a), 1 << 18):
        none = pa.nulls(len(a[i : i + (1 << 18)]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d[a[i : i + (1 << 18)]]), pa.array(d[b[i : i + (1 << 18)]]), none], ["a", "b", "h"])


PAIRS = "a long, b long, h long"


def _spanned(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, null) of row digests that may link, and (middle, null, h), from entries (h, tile, d1, n, g, bits)."""

    def run(batches):
        for part in _columns_of(batches, 2):
            # a tile that outgrew its size is read in pieces, which meet in their middles
            for i in range(0, len(part), max(READ, 2 * TILE)):
                h, row, maps, d, _ = _rows_of(part.slice(i, max(READ, 2 * TILE)), percent)
                middles: list[tuple[int, int]] = []
                yield from _pairs_out(d, *spanning_pairs(h, row, maps, middles=middles))
                split = {int(x) for x in h[part.column(1).to_numpy()[i : i + len(h)] >= 0]} | ({int(h[0]), int(h[-1])} if len(part) > len(h) else set())
                some = [(x, m) for x, m in middles if x in split]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(d[[m for _, m in some]]), pa.nulls(len(some), pa.int64()), pa.array([x for x, _ in some], pa.int64())], ["a", "b", "h"])

    return entries.select("h", "tile", "d1", "n", "g", "bits").mapInArrow(tidied(run), PAIRS)


def _unlinked(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of row digests that may link and are of different groups, from entries (h, i, j, d1, n, g, bits)."""

    def run(batches):
        seen = np.empty(0, np.uint64)  # of the pairs given out last

        for part in _columns_of(batches, 3):
            h, row, maps, d, g = _rows_of(part, percent)
            for a, b in unlinked_pairs(h, row, maps, g):
                code = mix(d[a].view(np.uint64) * U(31)) + mix(d[b].view(np.uint64), 1)
                new = ~np.isin(code, seen)
                seen = np.concatenate([seen, code[new]])[-(1 << 20) :]
                yield from _pairs_out(d, a[new], b[new])

    return entries.select("h", "i", "j", "d1", "n", "g", "bits").mapInArrow(tidied(run), PAIRS).select("a", "b").distinct()


def _block_of(h: np.ndarray) -> np.ndarray:
    """The block of a column: a range of hashes."""
    return (h >> U(64 - BLOCK_BITS)).astype(np.int64)


def _incidence(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, block, s): of each row asked for its sorted columns in every block in which it has any; written once."""

    def run(batches):
        for b in batches:
            for part, sets in batches_of_sets(b, 1, size):
                own, block, cut, flat = [], [], [0], []
                for i, s in zip(part.column(0).to_pylist(), sets):
                    at = np.searchsorted(_block_of(s), np.arange(BLOCKS + 1))
                    for k in np.flatnonzero(np.diff(at)).tolist():
                        own.append(i)
                        block.append(k)
                        flat.append(s[at[k] : at[k + 1]])
                        cut.append(cut[-1] + len(flat[-1]))
                columns = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(block, pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(columns))], ["id", "block", "s"])

    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).join(ids, "id", "left_semi").dropDuplicates(["id"])
    return materialize(texts.mapInArrow(tidied(run), "id long, block int, s array<long>"))


def products(x: pa.ListArray, y: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of rows of a block (sorted columns, null: none) the sizes and the number of columns in common, over whole buffers.

    The columns of both sides are put behind one another as (pair, column); where two neighbours in their order are equal, both rows
    hold the column.
    """
    n = len(x)
    held, sizes = [], []
    for side in (x, y):
        m = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(side), 0).to_numpy(zero_copy_only=False), np.int64)
        sizes.append(m)
        held.append((np.repeat(np.arange(n), m), side.flatten().to_numpy(zero_copy_only=False)))
    pair, column = (np.concatenate([a, b]) for a, b in zip(*held))
    order = np.lexsort((column, pair))
    pair, column = pair[order], column[order]
    same = (pair[1:] == pair[:-1]) & (column[1:] == column[:-1])
    return sizes[0], sizes[1], np.bincount(pair[1:][same], minlength=n)


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(u, v): representatives of possible pairs (a, b) whose accumulated overlap is large enough.

    The product of the incidence matrix with itself, under the mask of these pairs, a block of columns at a time: each block adds
    its counts to the pairs'. Between blocks a pair goes whose count and columns still to come, the fewer of both rows', stay below what its
    sizes ask for. After the last block the count alone decides.
    """
    pairs = materialize(pairs)
    ends = pairs.select(F.col("a").alias("x"), F.lit("a").alias("end")).union(pairs.select("b", F.lit("b"))).groupBy("x", "end").count()
    most = {end: (rows, top) for end, rows, top in ends.groupBy("end").agg(F.sum("count"), F.max("count")).collect()}
    total = most.get("a", (0, 0))[0]
    tops = {"u": most.get("a", (0, 0))[1], "v": most.get("b", (0, 0))[1]}

    def met(many: DataFrame, few: DataFrame, on: str, counts: DataFrame, spread: list[str], total: int, top: int, how: str) -> DataFrame:
        """many joined with few on the row `on`: a plain join, where no row has so many pairs that these must be split."""
        if top <= crowded(total):
            return many.join(few, on, how)
        return skew_join(many, few, [on], "often", spread, total, counts.groupBy(on).agg(F.count("*").alias("often")), how)

    known = pairs
    for digest_, own, n in (("a", "u", "nu"), ("b", "v", "nv")):
        known = met(known, reps.selectExpr(f"d1 as {digest_}", f"rep as {own}", f"n as {n}"), digest_, pairs, ["b" if digest_ == "a" else "a"], total, tops[own], "inner")
    # least overlap: 100 * c >= percent * (nu + nv - c); ru and rv are the columns still to come
    need = F.ceil(F.lit(percent) * (F.col("nu") + F.col("nv")) / (100 + percent)).cast("long")
    counted = materialize(known.select("u", "v", need.alias("need"), F.lit(0).cast("long").alias("c"), F.col("nu").cast("long").alias("ru"), F.col("nv").cast("long").alias("rv")).where("least(ru, rv) >= need"))
    ids = materialize(counted.select(F.col("u").alias("id")).union(counted.select("v")).distinct())
    if 2 * total <= FEW_IDS or ids.count() <= FEW_IDS:  # else the texts are shuffled to meet them
        ids = F.broadcast(ids)
    rows = _incidence(docs, ids, key, text, size)

    def add(batches):
        for b in batches:
            entries = sum(pa.compute.fill_null(pa.compute.list_value_length(b.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (6, 7))
            for i, j in slices(entries, ADDED):
                part = b.slice(i, j - i)
                nx, ny, both = products(part.column(6), part.column(7))
                need, c, ru, rv = (part.column(k).to_numpy() for k in (2, 3, 4, 5))
                c, ru, rv = c + both, ru - nx, rv - ny
                ok = c + np.minimum(ru, rv) >= need
                kept = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(kept) for k in (0, 1, 2)), pa.array(c[ok]), pa.array(ru[ok]), pa.array(rv[ok])], COUNTED_PAIRS.replace(" long", "").split(", "))

    for block in range(BLOCKS):
        joined, here = counted, rows.where(F.col("block") == block)
        for own, other in (("u", "v"), ("v", "u")):
            # a row without a column in this block meets a null, so that every pair keeps its place
            joined = met(joined, here.selectExpr(f"id as {own}", f"s as s{own}"), own, counted, [other], total, tops[own], "left")
        counted = materialize(joined.select("u", "v", "need", "c", "ru", "rv", "su", "sv").mapInArrow(tidied(add), COUNTED_PAIRS))
    return counted.where("c >= need").select("u", "v")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): documents linked at a Jaccard similarity of `percent` / 100 or more."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    features = materialize(_features(docs, key, text, size))
    some = features.where(f"n > 0 and `{key}` is not null")
    reps = materialize(some.groupBy("d1", "d2").agg(F.min(key).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    grid = _columns(docs, text, size, percent).repartition(parts, "h").sortWithinPartitions("h", "d1").mapInArrow(tidied(_shared), "h long, d1 long, rows long")
    held = grid.groupBy("d1").agg(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("r"), "h"))).alias("cols"))
    # what every partner shares with a row is `must` columns or more: one of them is left without the must - 1 fullest
    must = least_shared(F.col("n"), percent).cast("int")
    live = held.join(reps, "d1").where(F.size("cols") >= must).select("d1", "n", "bits", F.slice("cols", must, F.size("cols")).alias("cols"))
    live = materialize(live)
    tiles = F.ceil(-F.col("c.r") / F.lit(TILE))
    full = live.select(F.explode(F.slice("cols", 1, SPANNED)).alias("c"), "d1", "n", F.lit(0).cast("long").alias("g"), "bits")
    full = full.select("c.h", F.when(tiles > 1, F.pmod(F.xxhash64("d1"), tiles)).otherwise(-1).alias("tile"), "d1", "n", "g", "bits")
    sort = lambda df, *by: df.repartition(parts, *by).sortWithinPartitions(*by)
    spanned = materialize(_spanned(sort(full, "h", "tile"), percent))
    middles = spanned.where("b is null").select("h", F.col("a").alias("d1")).distinct().join(live.select("d1", "n", "bits"), "d1")
    middles = middles.select("h", F.lit(-1).cast("long").alias("tile"), "d1", "n", F.lit(0).cast("long").alias("g"), "bits")
    near = spanned.where("b is not null").select("a", "b").union(_spanned(sort(middles, "h", "tile"), percent).where("b is not null").select("a", "b")).distinct()
    links = _links(near, reps, docs, key, text, size, percent)
    named = components(links)
    known = reps.join(named, F.col("rep") == F.col("node")).select("d1", "component")
    again = live.join(known, "d1", "left").withColumn("g", F.coalesce("component", "d1"))
    every = again.select(F.explode("cols").alias("c"), "d1", "g").select("c.h", "d1", "g")
    mixed = materialize(every.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("rows")).where("low <> high").select("h", "rows"))
    some = skew_join(every, mixed, ["h"], "rows", ["d1"]).join(live.select("d1", "n", "bits"), "d1").withColumn("tiles", F.ceil(F.col("rows") / TILE))
    # each row goes to every pair of tiles that has its own
    own = F.pmod(F.xxhash64("d1"), F.col("tiles"))
    some = some.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    more = _links(_unlinked(sort(some, "h", "i", "j"), percent), reps, docs, key, text, size, percent)
    final = components(named.selectExpr("node as u", "component as v").union(more))
    whole = reps.join(final, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col(f"`{key}`").isNotNull(), F.coalesce("component", key)).alias("component_id")
    return features.join(whole, ["d1", "d2"], "left").select(key, F.col("n").alias("n_shingles"), component)
