"""N-gram Jaccard join by multiple-global-order filtering (operator 10).

A document is the set of its word shingles, as 64-bit hashes. If two sets have
Jaccard similarity t or more, the first n - ceil(t n) + m tokens of each, under
*any* total order of all tokens, share m tokens (m the smaller of theirs, by
size). So a set can only have a link if enough of its prefix is shared with
other sets, under every order; the filters of ``ORDERS`` orders are intersected,
each on what the ones before left, and whole sets are moved only of what passes all.

The orders put frequent tokens last, by classes of a count sketch of fixed size
over all documents, and differ by a hash within a class. A sketch that errs
only makes an order other, never a result.

Steps:

1. ``sketch_classes``: counts of all shingles in a fixed table, summed by block.
2. ``describe``: for each document its set's size and hash, and the prefix under the first
   order. Documents with equal sets are one node from here on.
3. ``sharing``: nodes with enough shared tokens in their prefix. Of them the sets are
   computed once more and stored, with the prefixes under the other orders, which filter in turn.
4. ``candidate_edges``: nodes that are left meet in the buckets of shared prefix tokens. Sizes and
   counts of tokens by part of the hash range (their L1 distance is at most the symmetric difference) rule
   out pairs, and a bucket passes on a spanning forest of what is left, at most one edge a
   row. Large buckets are dealt out as pairs of blocks.
5. The components of these edges are families: no link leaves one.
   ``verified_edges``: in a family, pairs that pass sizes, part counts and the prefixes of
   all orders are compared exactly, unless they are connected already; the
   links found form a forest. Its components are the result. A family of more than a block of rows or of
   tokens is dealt out in blocks, each with a few common members. If this leaves it in
   several components, those but the largest also meet all other blocks. Before any set of such a family is
   sent to blocks, ``refined`` splits it by counts of many more parts: long texts of one family are mostly alone then.

No step writes all pairs of a group, and none drops a group.

Defined cases: null and empty texts, and texts of white space, have the empty
set and link with nothing; with fewer words than a shingle the whole sequence
is one token; very long texts are hashed in slabs; rows that repeat are in one component; rows that repeat a doc_id with other texts are nodes of
their own; null doc_id is a row whose component_id is the least doc_id it
reaches, null if there is none; an empty table gives an empty result; other columns are ignored by :func:`link` and kept by :func:`keep_one`.
Equality of sets and tokens is that of 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ._common import broadcast_if_small, removed, shared_path, slices, stored, swept, table, text_or_empty
from .token_index import mix64

_U = np.uint64
#: Slots of the count sketch, and counts a block of it that is summed at once.
SLOTS, SLOT_BLOCK = 1 << 20, 1 << 16
PARTS, FINE_PARTS = 64, 256
#: Rows of a bucket, and nodes and tokens of a family, that one group holds before it is dealt out in blocks.
BUCKET, BLOCK, BLOCK_TOKENS = 1024, 160, 1 << 19
#: Members of a family that each of its blocks has besides its own.
HUBS = 6
#: Counts of parts in a block by which a large family is split, and most parts of a set.
REFINED, MOST_PARTS = 1 << 20, 4096
ORDERS = 3
#: Share of a set by which prefixes are longer than what shares one token.
LONGER = 0.1
#: Bytes hashed at once.
SLAB = 1 << 19

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as ascending uint64 hashes."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass").translate(_LOWER)
        if len(raw) > SLAB:
            out += _sets(group, k) if group else []
            out.append(_shingles(np.concatenate([_words([x])[0] for x in _slabs(raw)]), k))
            group, size = [], 0
            continue
        group.append(raw)
        size += len(raw) + 1
        if size > SLAB:
            out += _sets(group, k)
            group, size = [], 0
    return out + (_sets(group, k) if group else [])


def _slabs(raw: bytes):
    """Parts of a text, cut at spaces (or not, where it has none)."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLAB)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text (and the end)."""
    b = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    power, inverse = _power_tables(len(b) + 1)
    word = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum((b.astype(_U) + _U(1)) * power[: len(b)], out=total[1:])
    words = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return words, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    rolled = np.zeros(max(0, len(words) - k + 1), dtype=_U)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * _U((0xD1B54A32D192ED03 * (2 * j + 3) | 1) & (2**64 - 1))
    return mix64(rolled)


def _shingles(words: np.ndarray, k: int, rolled: np.ndarray | None = None) -> np.ndarray:
    if len(words) >= k:
        return np.unique(_rolled(words, k) if rolled is None else rolled[: len(words) - k + 1])
    if not len(words):
        return np.zeros(0, dtype=_U)
    whole = np.array([len(words)], dtype=_U)
    for j in range(len(words)):
        whole = mix64(whole * _U(0x2545F4914F6CDD1D) + words[j : j + 1])
    return whole


def _sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    words, first = _words(raws)
    rolled = _rolled(words, k)
    return [_shingles(words[a:e], k, rolled[a:]) for a, e in zip(first[:-1].tolist(), first[1:].tolist())]


def prefix_length(n: int, percent: int, more: int = 1) -> int:
    """Tokens of a set of ``n`` that share ``more`` with the like number of any set it links with."""
    return min(n, n - -(-n * percent // 100) + more)


def shared_by(n: int) -> int:
    """Tokens that longer prefixes of two sets share, the smaller of ``n`` tokens."""
    return 1 + int(LONGER * n)


def needed(n: int, percent: int) -> int:
    """Shared tokens in the longer prefix of a set of ``n`` that has a link: the other set may be smaller."""
    return shared_by(-(-n * percent // 100))


def in_order(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Place of tokens in a global order: class first, then a hash of its own."""
    rank = mix64(tokens ^ _U(0x632BE59BD9B4E019 * (order + 1) & (2**64 - 1))) >> _U(8)
    return (classes[(tokens & _U(len(classes) - 1)).astype(np.int64)].astype(_U) << _U(56)) | rank


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int, more: int = 1) -> np.ndarray:
    p = prefix_length(len(tokens), percent, more)
    return tokens[np.argpartition(in_order(tokens, classes, order), p - 1)[:p]] if p < len(tokens) else tokens


def part_counts(tokens: np.ndarray, parts: int) -> np.ndarray:
    shift = _U(64 - parts.bit_length() + 1)
    return np.minimum(np.bincount((tokens >> shift).astype(np.int64), minlength=parts), 255).astype(np.uint8)


def sketch_classes(docs: DataFrame, k: int) -> np.ndarray:
    """Class of each slot, 0 for at most twice the mean count, then one more with each doubling."""

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in slices(batches):
            for tokens in shingle_sets(batch.column(0).to_pylist(), k):
                np.add.at(total, (tokens & _U(SLOTS - 1)).astype(np.int64), 1)
        blocks = total.astype("<u4").reshape(-1, SLOT_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(count, "block int, counts binary")
    summed = counted.repartition(SLOTS // SLOT_BLOCK, "block").mapInArrow(add, "block int, counts binary")
    counts = np.zeros(SLOTS, dtype=np.int64)
    for r in summed.collect():  # SLOTS counts, whatever the input
        at = r["block"] * SLOT_BLOCK
        counts[at : at + SLOT_BLOCK] = np.frombuffer(r["counts"], "<i8")
    over = counts / max(1.0, 2 * float(counts.mean()))
    return np.where(over > 1, np.ceil(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def describe(docs: DataFrame, classes, k: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, node (hash of the set) and tokens (longer prefix under the first order) of ``docs(doc_id, text, key)``; ``classes`` is a broadcast."""

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            tokens = [prefix(s, classes.value, 0, percent, shared_by(len(s))).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())],
                names=["doc_id", "key", "n_shingles", "node", "tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "key")
    return rows.mapInArrow(run, "doc_id long, key long, n_shingles long, node long, tokens binary")


def postings(nodes: DataFrame, head=None) -> DataFrame:
    """(token, node) of ``nodes(node, tokens)``, of what ``head`` makes of the tokens if it is given."""

    def run(batches):
        for batch in slices(batches):
            raw = batch.column(1).to_pylist()
            if head is not None:
                raw = [head(np.frombuffer(x, _U)).tobytes() for x in raw]
            counts = [len(x) // 8 for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), counts))], names=["token", "node"])

    return nodes.select("node", "tokens").mapInArrow(run, "token long, node long")


def _shared(tokens: DataFrame) -> DataFrame:
    """``tokens(token, node)`` that more than one node has, with their number.

    The numbers are stored first: both sides of the join are then plain exchanges, so that a very common token is split.
    """
    counts = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "ngram-counts")
    swept(counts.sparkSession)
    return tokens.hint("merge").join(counts, "token")


def sharing(tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Nodes of ``sizes(node, n_shingles)`` that share enough of ``tokens(token, node)``, longer prefixes under one order."""
    need = F.floor(F.lit(LONGER) * F.floor((F.col("n_shingles") * percent + 99) / 100)) + 1
    hits = _shared(tokens).groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes.select("node", need.alias("need")), "node").where("hits >= need").select("node")


def sets_of(docs: DataFrame, reps: DataFrame, classes, k: int, percent: int) -> DataFrame:
    """node, n_shingles, tokens (all of them), parts and the longer prefixes under the other orders; ``reps(node, label, key)`` names one row of ``docs(doc_id, text, key)`` for each node."""
    rows = docs.select(_label().alias("label"), "key", text_or_empty().alias("text"))
    # merged at every size: what is moved then follows the input, also where few nodes would fit a broadcast
    rows = rows.join(reps.hint("merge"), ["label", "key"]).groupBy("label", "key").agg(F.first("node").alias("node"), F.first("text").alias("text"))

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            other = [pa.array([prefix(s, classes.value, order, percent, shared_by(len(s))).tobytes() for s in sets], pa.binary()) for order in range(1, ORDERS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([part_counts(s, PARTS).tobytes() for s in sets], pa.binary()), *other],
                names=["node", "n_shingles", "tokens", "parts", *(f"order{k}" for k in range(1, ORDERS))],
            )

    return rows.select("node", "text").mapInArrow(run, "node long, n_shingles long, tokens binary, parts binary, " + ", ".join(f"order{k} binary" for k in range(1, ORDERS)))


def _grouped(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns of sorted batches, as whole tables; a run may span batches.

    Yields (table, starts): all complete runs of a batch at once.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held:
            t = pa.concat_tables([*held, t]).combine_chunks()
        cols = [t.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(len(t), dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last), np.append(starts[:-1], last)
        held = [t.slice(last)]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, np.array([0, len(t)])


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _may_link(n_a, n_b, l1, percent: int):
    """Whether sizes and an L1 distance of part counts allow the similarity."""
    return (percent * np.maximum(n_a, n_b) <= 100 * np.minimum(n_a, n_b)) & (l1 * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _l1(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.abs(many.astype(np.int16) - one.astype(np.int16)).sum(axis=-1, dtype=np.int64)


def forest(n: np.ndarray, parts: np.ndarray, percent: int, agrees=None, tree: np.ndarray | None = None, home: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link, and for which ``agrees(i, j)`` holds if it is given.

    Pairs within one tree are skipped, so a clique costs one pass over its members; ``tree`` says what
    is connected already. Of pairs without a row at ``home`` none is looked at.
    """
    order = np.argsort(n, kind="stable")
    n, parts = n[order], parts[order]
    tree = np.arange(len(n)) if tree is None else tree[order]
    home = None if home is None or home.all() else home[order]
    out = []
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        js = np.arange(i + 1, end)
        js = js[tree[js] != tree[i]]
        if home is not None and not home[i]:
            js = js[home[js]]
        if not len(js):
            continue
        js = js[_may_link(n[i], n[js], _l1(parts[i], parts[js]), percent)]
        for j in js.tolist():
            if tree[j] != tree[i] and (agrees is None or agrees(int(order[i]), int(order[j]))):
                out.append((int(order[i]), int(order[j])))
                tree[tree == tree[j]] = tree[i]
    return out


def _dealt(rows: DataFrame, key: str, size: str, node: str, most=None) -> DataFrame:
    """Adds block columns lo and hi: (0, 0) for groups up to BUCKET (or a column of) rows, else every pair of blocks that the row's block is in."""
    blocks = F.ceil(F.col(size) / (F.lit(BUCKET) if most is None else most)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    pairs = F.when(blocks <= 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("lo"), F.greatest(x, own).alias("hi")))
    )
    out = rows.withColumn("pair", F.explode(pairs))
    return out.select(key, F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), *[c for c in rows.columns if c not in (key, size)])


def candidate_edges(nodes: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between nodes that share one of ``tokens(token, node)``, prefixes under one order, and may link by size and part counts."""
    facts = nodes.select("node", "n_shingles", "parts")
    met = _dealt(_shared(tokens).hint("merge").join(facts, "node"), "token", "rows", "node")

    def link(batches):
        for t, starts in _grouped(batches, 3):
            node, n = t.column("node").to_numpy(), t.column("n_shingles").to_numpy()
            parts = _fixed(t.column("parts"), PARTS)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            if len(two):
                l1 = np.abs(parts[two].astype(np.int16) - parts[two + 1]).sum(axis=1, dtype=np.int64)
                two = two[_may_link(n[two], n[two + 1], l1, percent)]
            u, v = [node[two]], [node[two + 1]]
            for a, size in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                pairs = forest(n[a : a + size], parts[a : a + size], percent)
                if pairs:
                    at = np.array(pairs) + a
                    u.append(node[at[:, 0]])
                    v.append(node[at[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    met = met.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    met = met.select("token", "lo", "hi", "node", "n_shingles", "parts")
    return met.mapInArrow(link, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _shares(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked_pairs(rows: DataFrame, classes, percent: int) -> DataFrame:
    """Edges (u, v) of a forest of exact links in each group of ``rows(family, block, node, tree, home, tokens)``."""

    def verify(batches):
        for t, starts in _grouped(batches, 2):
            node, tree, home = (t.column(c).to_numpy() for c in ("node", "tree", "home"))
            tokens = t.column("tokens")
            us, vs = [], []
            for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - a < 2:
                    continue
                sets = [np.frombuffer(x, _U) for x in tokens.slice(a, e - a).to_pylist()]
                n = np.array([len(s) for s in sets])
                parts = np.stack([part_counts(s, FINE_PARTS) for s in sets])
                prefixes: dict[tuple[int, int], np.ndarray] = {}

                def head(x, order):
                    if (x, order) not in prefixes:
                        prefixes[x, order] = np.sort(prefix(sets[x], classes.value, order, percent))
                    return prefixes[x, order]

                def links(i, j):
                    if not all(_shares(head(i, order), head(j, order)) for order in range(ORDERS)):
                        return False
                    both = _shares(sets[i], sets[j])
                    return 100 * both >= percent * (n[i] + n[j] - both)

                for i, j in forest(n, parts, percent, links, tree[a:e], home[a:e] == 1):
                    us.append(node[a + i])
                    vs.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = rows.repartition("family", "block").sortWithinPartitions("family", "block").select("family", "block", "node", "tree", "home", "tokens")
    return rows.mapInArrow(verify, "u long, v long")


def refined(held: DataFrame, percent: int) -> DataFrame:
    """(node, n_shingles, family) of stored ``held(node, n_shingles, tokens, family)``, families of more than a block split where part counts allow no link.

    Counts of some two to four tokens a part tell apart what the few parts of ``candidate_edges`` can't in long sets, at a
    sixteenth of their bytes or less. What is alone in a family then is left out. Blocks of these counts meet in pairs.
    """
    nodes = held.select("node", "n_shingles", "family")
    sizes = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"))
    parts = F.least(F.lit(MOST_PARTS), F.greatest(F.lit(FINE_PARTS), F.pow(F.lit(2), F.floor(F.log2(F.col("weight") / F.col("size"))) - 1))).cast("int")
    large = stored(sizes.where(_blocks() > 1).select("family", "size", parts.alias("parts")), "ngram-large")
    if large.isEmpty():
        return nodes
    per_block = F.least(F.lit(BUCKET), F.greatest(F.lit(2), F.floor(F.lit(REFINED) / F.col("parts")))).cast("int")
    large = broadcast_if_small(large.withColumn("per_block", per_block))  # the sets stay where they are

    def count(batches):
        for batch in slices(batches):
            kinds = batch.column(4).to_pylist()
            fine = [part_counts(np.frombuffer(x, _U), p).tobytes() for x, p in zip(batch.column(3).to_pylist(), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2)), pa.array(fine, pa.binary()), *(batch.column(c) for c in (5, 6))], names=["node", "n_shingles", "family", "fine", "size", "per_block"])

    def split(batches):
        for t, starts in _grouped(batches, 3):
            node, n, fine = t.column("node").to_numpy(), t.column("n_shingles").to_numpy(), t.column("fine")
            us, vs = [], []
            for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                rows = fine.slice(a, e - a).to_pylist()
                for i, j in forest(n[a:e], np.frombuffer(b"".join(rows), np.uint8).reshape(e - a, -1), percent):
                    us.append(node[a + i])
                    vs.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = held.join(large, "family").select("node", "n_shingles", "family", "tokens", "parts", "size", "per_block")
    fine = rows.mapInArrow(count, "node long, n_shingles long, family long, fine binary, size long, per_block int")
    met = _dealt(fine, "family", "size", "node", F.col("per_block")).repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    edges = stored(met.select("family", "lo", "hi", "node", "n_shingles", "fine").mapInArrow(split, "u long, v long"), "ngram-refined")
    swept(held.sparkSession)
    small = nodes.join(large.select("family"), "family", "left_anti").select("node", "n_shingles", "family")
    parted = nodes.select("node", "n_shingles").join(components(edges).withColumnRenamed("root", "family"), "node")
    return stored(small.unionByName(parted), "ngram-families")


def _blocks():
    """Blocks of a family of ``size`` rows and ``weight`` tokens."""
    return F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_TOKENS)).cast("int")


def verified_edges(sets: DataFrame, families: DataFrame, classes, percent: int) -> DataFrame:
    """Edges (u, v) of links that connect what is linked; ``families(node, family)`` of stored ``sets(node, n_shingles, tokens)``."""
    held = stored(sets.select("node", "n_shingles", "tokens").hint("merge").join(families, "node"), "ngram-held")
    swept(held.sparkSession)
    families = refined(held, percent)
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"))
    blocks = _blocks()
    families = families.select("node", "family")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = families.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("own", own)
    some = F.explode(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node"))["node"] for k in range(HUBS)])))
    hubs = dealt.where("blocks > 1").groupBy("family").agg(some.alias("node")).withColumn("hub", F.lit(True))
    dealt = stored(dealt.join(hubs, ["family", "node"], "left").withColumn("hub", F.coalesce("hub", F.lit(False))), "ngram-blocks")

    def met(rows: DataFrame) -> DataFrame:
        """``rows(node, family, own, places, tree)`` with their sets, in each of the blocks that they have a place in."""
        rows = held.select("node", "tokens").hint("merge").join(rows, "node").withColumn("block", F.explode("places"))
        return rows.select("family", "block", "node", "tree", (F.col("block") == F.col("own")).cast("int").alias("home"), "tokens")

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own_and_common = dealt.select("node", "family", "own", F.col("node").alias("tree"), F.when(F.col("hub"), every).otherwise(F.array("own")).alias("places"))
    first = stored(_linked_pairs(met(own_and_common), classes, percent), "ngram-links")
    swept(held.sparkSession)
    many = dealt.where("blocks > 1")
    if many.isEmpty():
        return first
    trees = many.join(components(first), "node", "left").withColumn("tree", F.coalesce("root", "node")).drop("root")
    trees = stored(trees, "ngram-trees")
    counts = trees.groupBy("family", "tree").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "tree"))["tree"].alias("main"), F.count(F.lit(1)).alias("trees")).where("trees > 1")
    places = F.when(F.col("tree") == F.col("main"), F.array("own")).otherwise(every)
    second = _linked_pairs(met(trees.join(main, "family").select("node", "family", "own", "tree", places.alias("places"))), classes, percent)
    return stored(first.unionByName(second), "ngram-links")


def _label():
    """The doc_id, with null as a value of its own."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _row_key(columns: list[str]):
    """A hash of these columns of a row; the hash of Spark skips nulls, so where they are counts too."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, node and component_id of each row of ``docs(doc_id, text)``."""
    return _linked(docs.select("doc_id", "text", _row_key(["text"]).alias("key")), k, percent).drop("key", "root")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """What :func:`link` returns, with the key of each row of ``docs(doc_id, text, key)`` and root, the same in a component and null for empty sets."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(sketch_classes(docs, k))  # SLOTS bytes
    wide = [shared_path(spark, f"ngram-{name}") for name in ("documents", "nodes", "sets")]
    described = stored(describe(docs, classes, k, percent), "", wide[0])
    members = stored(described.select("doc_id", "key", "n_shingles", "node"), "ngram-members")
    facts = described.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(_label().alias("label"), "key")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")
    )
    facts = stored(facts, "", wide[1])
    del described
    removed(spark, wide[0])  # prefixes lie with the nodes now
    nodes = stored(facts.select("node", "least", "row"), "ngram-least")
    passing = stored(sharing(postings(facts), facts, percent), "ngram-passing")
    del facts
    removed(spark, wide[1])
    reps = nodes.join(passing, "node").select("node", "row.label", "row.key")
    sets = stored(sets_of(docs, reps, classes, k, percent), "", wide[2])
    del reps
    swept(spark)
    for order in range(1, ORDERS):
        tokens = postings(sets.select("node", F.col(f"order{order}").alias("tokens")).hint("merge").join(passing, "node"))
        passing = stored(sharing(tokens, sets, percent), "ngram-passing")
        del tokens
        swept(spark)
    sets = sets.join(passing.hint("merge"), "node")
    heads = postings(sets, lambda tokens: prefix(tokens, classes.value, 0, percent))
    edges = stored(candidate_edges(sets, heads, percent), "ngram-candidates")
    swept(spark)
    families = stored(components(edges).withColumnRenamed("root", "family"), "ngram-families")
    edges = verified_edges(sets, families, classes, percent)
    joined = components(edges)
    del sets, heads
    removed(spark, wide[2])
    least = nodes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = least.join(roots, "root").select("node", "root", "component_id")
    out = members.join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "node", component.alias("component_id"), "key", "root")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of its least doc_id, null last, and of rows that repeat this doc_id that of the least key.

    Empty sets link with nothing: of them, only rows that repeat in all columns become one.
    """
    key = _row_key(docs.columns)
    linked = _linked(docs.select("doc_id", "text", key.alias("key")), k, percent)
    alone = F.when(F.col("root").isNull(), F.struct("doc_id", "key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), _label().alias("label"), "key"))
    kept = linked.groupBy("root", alone.alias("alone")).agg(first.alias("row"))
    kept = stored(kept.select(F.col("row.label").alias("__label"), F.col("row.key").alias("__key")), "ngram-kept")
    del linked
    swept(docs.sparkSession)
    rows = docs.withColumns({"__label": _label(), "__key": key}).join(kept, ["__label", "__key"], "left_semi")
    return rows.dropDuplicates(["__label", "__key"]).select(docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(table(spark, sf_dir, "documents"), k=3, percent=90)
    return linked.select("doc_id", "n_shingles", "component_id")
