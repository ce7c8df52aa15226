"""N-gram Jaccard join: a size-aware heavy-light similarity join of shingle sets.

Equal sets are one set from the start. Small sets enumerate the pairs (subsets
of two) of a short prefix of their rarest shingles; large sets scan the inverted
lists of their prefix shingles. Where small ends is chosen by cost from the
sizes and the repetition that is measured. Both are exact filters: two sets over
the threshold share a pair, or a prefix shingle.

Lists never give all their pairs. A short list does, a long one gives links to
a few leaders; members that the verified links already connect need no further
test, and only members of different components of one list meet afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scan
from ._io import batch_of, partitions, release, row_slices, store, text_buffers
from .graph import components

_U = np.uint64
_SLICE = 2 << 20
#: Values of one task that are counted together; a value less often in them is not reported as frequent.
_COUNTED, _REPORTED = 1 << 21, 2
#: The order "rare first" knows this many frequent shingles at most; any order gives the same links.
_FREQUENT, _FREQUENT_FROM = 1 << 19, 4
#: Lists up to this long give all pairs at once; longer ones have so many leaders.
_SHORT, _LEADERS = 6, 2
#: Least and most bits of the filter that says which sets a verification needs, as powers of two, and where a set id's bits for it start.
_BLOOM, _BLOOM_MOST, _BLOOM_SHIFTS = 22, 27, (0, 18, 36)
#: From so many sets on, one shingle's list is dealt to several tasks, to so many where only the key is known.
_SPLIT, _SALTS = 2048, 64
#: Rows of one list that meet as many in one task afterwards, and pairs of them that are screened at once.
_LIST_ROWS, _PAIRS_AT_ONCE = 2048, 1 << 15


@dataclass(frozen=True)
class Rule:
    """Words in a shingle and the least Jaccard similarity, as a fraction."""

    words: int = 5
    num: int = 3
    den: int = 4

    def needed(self, n: int) -> int:
        """Shingles of a set of ``n`` that any similar set holds at least."""
        return -(-n * self.num // self.den)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row (A-Z are lower-cased)."""
    starts, ends, reach = _scan.word_bounds(data, offsets)
    words = _scan.slice_hashes(data, starts, ends, lower=True)
    grams = _scan.window_hashes(words, k)
    out = []
    for lo, hi in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True):
        if hi - lo >= k:
            own = np.sort(grams[lo : hi - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif hi > lo:
            out.append(_scan.window_hashes(np.concatenate((words[lo:hi], np.full(k - hi + lo, hi - lo, _U))), k))
        else:
            out.append(np.empty(0, _U))
    return out


def set_id(own: np.ndarray) -> int:
    """A 64-bit id of a set."""
    if not len(own):
        return 0
    with np.errstate(over="ignore"):
        total = _scan.mix(own + _U(0x9E3779B97F4A7C15)).sum(dtype=_U) + _U(len(own)) * _U(0xC2B2AE3D27D4EB4F)
    return int(_scan.mix(np.array([total], _U)).view(np.int64)[0])


def _sliced(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.num_columns - 1))
        for lo, hi in row_slices(offsets, _SLICE):
            own = offsets[lo : hi + 1]
            yield batch.slice(lo, hi - lo), shingle_sets(data[own[0] : own[-1]], own - own[0], k)


def parity_bits(own: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes over a power of two of bits, four to eight times its size.

    Two such bitmaps differ in no more bits than the sets differ in members, so
    their distance bounds the similarity from above. Halves of the longer one
    are combined where the lengths differ.
    """
    m = max(64, 4 << (len(own) - 1).bit_length())
    odd = np.bincount((_scan.mix(own) & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """kind 0: a = doc_id, b = set id, n = size, bits once a share of rows. kind 1: a = a shingle, n = its count in one share."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        n = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts >= _REPORTED
            m = int(often.sum())
            return batch_of(schema, np.ones(m, np.int8), values[often].view(np.int64), np.zeros(m, np.int64), counts[often], pa.nulls(m, pa.list_(pa.int64())))

        for batch, sets in _sliced(batches, rule.words):
            ids = [set_id(s) for s in sets]
            bits: list[np.ndarray | None] = []
            for i, s in zip(ids, sets, strict=True):
                new = i not in seen and len(s) > 0
                bits.append(parity_bits(s) if new else None)
                if new:
                    seen.add(i)
                    waiting.append(s)
                    n += len(s)
            yield batch_of(schema, np.zeros(len(ids), np.int8), batch.column(0), ids, [len(s) for s in sets], bits)
            if n >= _COUNTED:
                yield counted()
                waiting, n = [], 0
                seen.clear()
        if n:
            yield counted()

    return docs.mapInArrow(run, "kind tinyint, a bigint, b bigint, n bigint, bits array<bigint>")


def boundary(sizes: dict[int, int], repetition: float, rule: Rule) -> int:
    """The largest size that counts as small: the cheapest split of enumerating and scanning.

    Enumerating costs a row a pair; scanning costs a row a prefix shingle and a
    candidate for each leader that a repeated shingle meets.
    """
    best, cost = 0, 0.0
    least = 0.0
    for n in sorted(sizes):
        spare = n - rule.needed(n)
        if rule.needed(n) < 2:  # such a set has no similar set but itself
            continue
        pairs = (spare + 2) * (spare + 1) / 2
        scans = (spare + 1) * (1 + min(repetition, _LEADERS + 1))
        cost += sizes[n] * (pairs - scans)
        if cost < least:
            best, least = n, cost
    return best


def _postings(docs: DataFrame, rule: Rule, limit: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(share, key, sid, n): pairs of small sets (odd keys) and prefix shingles (even keys).

    A key's second bit says that its list is dealt to several shares.
    """
    schema = pa.schema([("share", pa.int32()), ("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())])
    values, counts = frequent
    met = rule.needed(limit + 1)  # small sets from this size on can be similar to large ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sliced(batches, rule.words):
            keys: list[np.ndarray] = []
            weights: list[np.ndarray] = []
            owners: list[tuple[int, int, int]] = []
            lengths = np.array([len(s) for s in sets])
            whole = np.concatenate(sets) if sets else np.empty(0, _U)
            weight = np.zeros(len(whole), np.int64)
            if len(values) and len(whole):
                at = np.minimum(np.searchsorted(values, whole), len(values) - 1)
                weight = np.where(values[at] == whole, counts[at], 0)
            ends = np.cumsum(lengths)
            for own, hi in zip(sets, ends.tolist(), strict=True):
                n = len(own)
                if n < 2:
                    continue
                sid = set_id(own)
                if sid in seen:
                    continue
                seen.add(sid)
                w = weight[hi - n : hi]
                spare = n - rule.needed(n)
                take = min(n, spare + 2)
                rare = np.flatnonzero(w == 0)[:take]
                if len(rare) < take:
                    often = np.flatnonzero(w)
                    rare = np.concatenate((rare, often[np.argsort(w[often], kind="stable")][: take - len(rare)]))
                head, head_w = own[rare], w[rare]
                if n <= limit and rule.needed(n) >= 2:
                    i, j = np.triu_indices(take, 1)
                    low, high = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
                    keys.append((_scan.mix(low ^ _scan.mix(high)) & ~_U(3)) | _U(1))
                    weights.append(np.minimum(head_w[i], head_w[j]))
                    owners.append((sid, n, len(i)))
                if n > limit or n >= met:
                    keys.append(head[: spare + 1] & ~_U(3))
                    weights.append(head_w[: spare + 1])
                    owners.append((sid, n, len(keys[-1])))
            if len(seen) > 1 << 20:
                seen.clear()
            if keys:
                key, w = np.concatenate(keys), np.concatenate(weights)
                reps = [o[2] for o in owners]
                sid = np.repeat(np.array([o[0] for o in owners], np.int64), reps)
                shares = (w // _SPLIT + 1).astype(_U)
                key |= (shares > 1).astype(_U) << _U(1)
                share = (_scan.mix(sid.view(_U)) % shares).astype(np.int32)
                yield batch_of(schema, share, key.view(np.int64), sid, np.repeat(np.array([o[1] for o in owners], np.int32), reps))

    return docs.mapInArrow(run, "share int, key bigint, sid bigint, n int").repartition(partitions(docs.sparkSession), "key", "share")


def _may_link(na: np.ndarray, nb: np.ndarray, rule: Rule) -> np.ndarray:
    return np.minimum(na, nb).astype(np.int64) * rule.den >= np.maximum(na, nb).astype(np.int64) * rule.num


def _scan_lists(postings: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """kind 0: a candidate pair of sets a < b. kind 1: set b of size n stands in the long list of key a."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for i, c in enumerate(columns):
                c.append(batch.column(i + 1).to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        key, sid, n = (np.concatenate(c) for c in columns)
        order = np.lexsort((sid, key))
        key, sid, n = key[order], sid[order], n[order]
        new = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
        key, sid, n = key[new], sid[new], n[new]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for m in range(2, _SHORT + 1):  # all lists of one length at once
            at = heads[sizes == m]
            for i in range(m):
                for j in range(i + 1, m):
                    left.append(at + i)
                    right.append(at + j)
        dealt = key[heads] & 2 != 0  # such a list has company in other shares, even if it is short here
        long = np.flatnonzero((sizes > _SHORT) | dealt)
        rank = _scan.mix(sid.view(_U))
        rows = []
        for k in long.tolist():
            lo, hi = int(heads[k]), int(heads[k] + sizes[k])
            rows.append(np.arange(lo, hi))
            if sizes[k] <= _SHORT:
                continue
            may = np.arange(lo, hi) if key[lo] & 1 else lo + np.flatnonzero(n[lo:hi] > limit)
            for leader in may[np.argsort(rank[may])[:_LEADERS]].tolist():
                left.append(np.full(hi - lo, leader))
                right.append(np.arange(lo, hi))
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            ok = (a != b) & _may_link(n[a], n[b], rule) & ((key[a] & 1 == 1) | (np.maximum(n[a], n[b]) > limit))
            a, b = sid[a[ok]], sid[b[ok]]
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            yield batch_of(schema, np.zeros(len(pairs), np.int8), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32))
        if rows:
            at = np.concatenate(rows)
            yield batch_of(schema, np.ones(len(at), np.int8), key[at], sid[at], n[at])

    return postings.mapInArrow(run, "kind tinyint, a bigint, b bigint, n int")


def _sized(na: Column, nb: Column, rule: Rule) -> Column:
    return F.least(na, nb) * rule.den >= F.greatest(na, nb) * rule.num


def _size_class(n: Column, rule: Rule) -> Column:
    """A number for sizes; those of two sets that may be similar differ by one at most.

    The classes are a trifle wider than the ratio that the rule allows, so rounding
    parts no pair.
    """
    ratio = rule.den / rule.num
    return F.floor(F.log(n.cast("double")) / (math.log(ratio) * 1.0001)) if ratio > 1 else n.cast("bigint")


def _near(x: Column, y: Column, na: Column, nb: Column, rule: Rule) -> Column:
    """Whether sizes and parity bits leave room for the similarity; never false for a similar pair."""

    def folded(p: Column, q: Column) -> Column:
        h = F.size(q)
        return F.when(F.size(p) > h, F.zip_with(F.slice(p, F.lit(1), h), F.slice(p, h + 1, h), lambda s, t: s.bitwiseXOR(t))).otherwise(p)

    distance = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda acc, c: acc + c)
    return F.when(_sized(na, nb, rule), distance * (rule.den + rule.num) <= (na + nb) * (rule.den - rule.num)).otherwise(False)


def _bloom(wanted: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2**``bits`` bits over the column sid, as the words that the driver gets."""
    places = F.explode(F.array(*(F.shiftright("sid", k).bitwiseAND((1 << bits) - 1) for k in _BLOOM_SHIFTS))).alias("p")
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    rows = wanted.select(places).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("m")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out


def _row_key(sid: Column, doc_id: Column) -> Column:
    """A set and a document as one number for the filter; ``_set_table`` makes the same."""
    return sid.bitwiseXOR(F.shiftleft(doc_id, 21).bitwiseOR(F.shiftrightunsigned(doc_id, 43)))


def _set_table(docs: DataFrame, filled: np.ndarray, rule: Rule) -> DataFrame:
    """(sid, doc_id, members): the sorted shingles of the sets whose set and document pass the filter, once a task for rows that repeat."""
    schema = pa.schema([("sid", pa.int64()), ("doc_id", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, sets in _sliced(batches, rule.words):
            ids = np.array([set_id(s) for s in sets], np.int64)
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            keys = (ids.view(_U) ^ (doc << _U(21) | doc >> _U(43))).view(np.int64)
            keep = np.ones(len(ids), bool)
            for k in _BLOOM_SHIFTS:
                p = (keys >> k) & ((len(filled) << 6) - 1)
                keep &= (filled[p >> 6] >> (p & 63)) & 1 == 1
            at = [i for i in np.flatnonzero(keep).tolist() if int(keys[i]) not in seen and not seen.add(int(keys[i]))]
            if at:
                yield batch_of(schema, ids[at], batch.column(0).take(pa.array(at)), [sets[i].astype("<u8").tobytes() for i in at])

    return docs.mapInArrow(run, "sid bigint, doc_id bigint, members binary")


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(u, v), perhaps repeated, of the pairs (a, u, b, v) of sets and their documents that are similar enough.

    The sets are made again from the texts, of the documents in the pairs alone:
    copies under other ids and repeated rows are left out. They stand as a table
    until the links do.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (2, 3))
                both = len(x) + len(y) - len(np.union1d(x, y))
                if both * rule.den >= rule.num * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                at = pa.array(keep)
                yield batch_of(schema, batch.column(0).take(at), batch.column(1).take(at))

    bits = min(_BLOOM_MOST, max(_BLOOM, (16 * pairs.count()).bit_length()))
    sets = store(_set_table(docs, _bloom(pairs.select(F.explode(F.array(_row_key(F.col("a"), F.col("u")), _row_key(F.col("b"), F.col("v")))).alias("sid")), bits), rule), "members")
    first = pairs.join(sets.select(F.col("sid").alias("a"), F.col("doc_id").alias("u"), F.col("members").alias("x")), ["a", "u"])
    second = first.join(sets.select(F.col("sid").alias("b"), F.col("doc_id").alias("v"), F.col("members").alias("y")), ["b", "v"])
    links = store(second.select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint"), "links")
    release(sets)
    return links


def _folded(bits: list[np.ndarray], words: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of at least ``to`` words, combined down to ``to``, and each one's row in that matrix."""
    at = np.flatnonzero(words >= to)
    place = np.full(len(words), -1)
    place[at] = np.arange(len(at))
    return np.stack([np.bitwise_xor.reduce(bits[i].reshape(-1, to), axis=0) for i in at.tolist()]), place


def _pairs_in_block(n: np.ndarray, root: np.ndarray, slot: np.ndarray, bits: list[np.ndarray], least: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different roots whose sizes and bits leave room, the larger one over ``least``.

    Where the block joins two slots, only pairs across them. Rows are taken by
    size, so that very different sizes never meet.
    """
    order = np.argsort(n, kind="stable")
    n, root, slot = n[order].astype(np.int64), root[order], slot[order]
    bits = [bits[i] for i in order.tolist()]
    words = np.array([len(x) for x in bits])
    across = slot.min() != slot.max()
    ends = np.searchsorted(n * rule.num, n * rule.den, "right")
    counts = np.maximum(ends - np.arange(len(n)) - 1, 0)
    reach = np.cumsum(counts)
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    lo = 0
    while lo < len(n):
        done = int(reach[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(reach, done + _PAIRS_AT_ONCE, "right")))
        own = counts[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(reach[lo:hi] - own - done, own)
        ok = (root[i] != root[j]) & (n[j] > least)
        if across:
            ok &= slot[i] != slot[j]
        i, j = i[ok], j[ok]
        shorter = np.minimum(words[i], words[j])
        for w in np.unique(shorter).tolist():
            if w not in folded:
                folded[w] = _folded(bits, words, w)
            table, place = folded[w]
            x, y = i[shorter == w], j[shorter == w]
            apart = np.bitwise_count((table[place[x]] ^ table[place[y]]).view(_U)).sum(axis=1, dtype=np.int64)
            near = apart * (rule.den + rule.num) <= (n[x] + n[y]) * (rule.den - rule.num)
            left.append(order[x[near]])
            right.append(order[y[near]])
        lo = hi
    return np.concatenate(left), np.concatenate(right)


def _last_meeting(rows: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Pairs (a, u, b, v) of sets in one list whose components differ and whose sizes and bits leave room.

    A list meets in blocks of ``_LIST_ROWS`` by as many rows, so no task has a
    whole list. A row goes once to each block of its slot.
    """
    schema = pa.schema([(c, pa.int64()) for c in "aubv"])
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def met(table: pa.Table) -> pa.RecordBatch | None:
            table = table.combine_chunks()
            key, first, second, slot, a, n, u, root = (table.column(i).to_numpy() for i in range(8))
            if len(key) < 2 or (root == root[0]).all() or (first[0] != second[0] and (slot == slot[0]).all()):
                return None
            lists = table.column(8).chunk(0)
            offsets = lists.offsets.to_numpy()
            data = lists.values.to_numpy()
            bits = [data[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            i, j = _pairs_in_block(n, root, slot, bits, 0 if key[0] & 1 else limit, rule)
            i, j = np.where(root[i] < root[j], i, j), np.where(root[i] < root[j], j, i)
            return batch_of(schema, a[i], u[i], a[j], u[j]) if len(i) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            block = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in block], axis=0)) + 1
            if waiting and any(waiting[-1].column(i)[-1].as_py() != int(c[0]) for i, c in enumerate(block)):
                cuts = np.append(0, cuts)
            lo = 0
            for hi in cuts.tolist():
                out = met(pa.Table.from_batches([*waiting, batch.slice(lo, hi - lo)]))
                waiting, lo = [], hi
                if out is not None:
                    yield out
            waiting.append(batch.slice(lo))
        if waiting and (out := met(pa.Table.from_batches(waiting))) is not None:
            yield out

    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1))
    blocks = rows.withColumn("t", other).select(
        "key", F.least("slot", "t").alias("s"), F.greatest("slot", "t").alias("t"), "slot", "a", F.col("na").cast("int").alias("na"), "u", "root", "x"
    )
    dealt = blocks.repartition(partitions(spark), "key", "s", "t").sortWithinPartitions("key", "s", "t")
    return dealt.mapInArrow(run, "a bigint, u bigint, b bigint, v bigint")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), star_rounds: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_shingles, component_id, set_id), one row a row.

    component_id is the smallest doc_id that links reach. Rows without words
    have the empty set and stand alone, as do rows with a null doc_id (their
    component_id is null). Rows with one doc_id but different texts are
    separate sets. Other columns are ignored. Any number of ``star_rounds``, in
    which a long list meets one more leader, gives the same components; a round
    costs a pass over the texts and saves the last meeting work.
    """

    def sides(of: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(of.select(*(F.col(c).alias(d) for c, d in zip(("sid", "n", "rep", "bits"), names, strict=True))) for names in (("a", "na", "u", "x"), ("b", "nb", "v", "y")))

    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = own.where(F.col("doc_id").isNotNull())
    facts = store(_describe(own, rule), "sets")
    members = facts.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), F.col("n"))
    smallest = members.where("doc_id is not null and n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"))
    bits = facts.where("kind = 0 and bits is not null").groupBy(F.col("b").alias("sid")).agg(F.max("bits").alias("bits"))
    reps = store(smallest.join(bits, "sid").select("sid", F.col("n").cast("int").alias("n"), "rep", "bits"), "representatives")
    often = facts.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= _FREQUENT_FROM)
    top = often.orderBy(F.desc("n"), "a").limit(_FREQUENT).toPandas()
    values = top["a"].to_numpy(np.int64).view(_U)
    order = np.argsort(values)
    frequent = values[order], top["n"].to_numpy(np.int64)[order]
    sizes = {int(r[0]): int(r[1]) for r in reps.groupBy(F.least("n", F.lit(4096))).count().collect()}
    total = sum(n * c for n, c in sizes.items())
    repetition = float((frequent[1].astype(float) * (frequent[1] - 1)).sum() / max(total, 1))
    limit = boundary(sizes, repetition, rule)

    lists = store(_scan_lists(_postings(known, rule, limit, frequent), rule, limit), "lists")
    # shingles of one passage make lists of the same sets; one list of each kind says it all
    dealt = lambda sid: F.when(F.col("key").bitwiseAND(2) != 0, sid).otherwise(F.lit(0))
    every = lists.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("sid")).withColumn("salt", dealt(F.pmod(F.xxhash64("sid"), F.lit(_SALTS))))
    alike = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("h")).groupBy("n", "h", F.col("key") % 2).agg(F.min("key").alias("key"))
    salted = alike.select("key", F.expr(f"n div {_LIST_ROWS} + 1").alias("slots"), F.explode(F.sequence(F.lit(0).cast("bigint"), dealt(F.lit(_SALTS - 1)).cast("bigint"))).alias("salt"))
    long = store(every.join(salted, ["key", "salt"]).select("key", "sid", "slots", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("slots")).alias("slot")), "long")
    left, right = sides(reps)
    first = lists.where("kind = 0").select("a", "b").distinct().join(left, "a").join(right, "b")
    pairs = store(first.where(_near(F.col("x"), F.col("y"), F.col("na"), F.col("nb"), rule)).select("a", "u", "b", "v"), "pairs")
    links = _verified(pairs, known, rule)
    roots = components(links)
    release(lists, pairs, links)
    # only sets of long lists meet again
    held = store(reps.join(long.select("sid").distinct(), "sid", "left_semi"), "held")
    left, right = sides(held)
    for turn in range(star_rounds + 1):
        labelled = (
            long.join(held.select("sid", "n", "rep"), "sid")
            .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
            .select("key", "slots", "slot", F.col("sid").alias("a"), "n", F.coalesce("root", "rep").alias("root"), _size_class(F.col("n"), rule).alias("class"))
        )
        # sets of two different components can only meet in neighbouring classes of size;
        # each list and class has a leader of its own, so lists with the same sets try different ones
        own_class = labelled.groupBy("key", "slots", "class").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("a", "key", F.lit(turn)).alias("r"), "a", "root", "n")).alias("lead"))
        near_class = own_class.withColumn("class", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)))
        mixed = near_class.groupBy("key", "slots", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lead").alias("lead")).where("lo <> hi")
        rows = labelled.join(mixed.select("key", "class", "lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot")), ["key", "slot", "class"])
        near = _near(F.col("x"), F.col("y"), F.col("na"), F.col("nb"), rule)
        if turn < star_rounds:
            met = rows.where((F.col("root") != F.col("lead.root")) & _sized(F.col("n"), F.col("lead.n"), rule)).select("a", F.col("lead.a").alias("b")).distinct().join(left, "a").join(right, "b").where(near)
        else:
            met = _last_meeting(rows.select("key", "slots", "slot", "a", "root").join(left, "a"), rule, limit).distinct()
        more = store(met.select("a", "u", "b", "v"), "pairs")
        if not more.isEmpty():
            # what is settled goes on as stars: a link a node, however many links made it
            links = _verified(more, known, rule)
            roots = components(links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
            release(links)
        release(more)
    release(held, long)
    found = reps.select("sid", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("sid", F.coalesce("root", "rep").alias("root"))
    return members.join(found, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))).alias("component_id"), F.col("sid").alias("set_id")
    )


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each group of linked rows of ``docs(doc_id, text, ...)``, with all its columns.

    Rows are told apart by a key of their own, so repeated rows and rows with one
    doc_id but different texts are judged by their texts alone. The row with the
    smallest doc_id stays, null doc_ids last; of equal ones any single row. Rows
    without words are linked with nothing and all stay. ``docs`` is written once
    with its keys; a column named _row is replaced.
    """
    keyed = store(docs.drop("_row").withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text"), rule).select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("r"))
    stay = keyed.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(F.min(place).alias("m")).select(F.col("m.r").alias("_row"))
    return keyed.join(stay, "_row", "left_semi").drop("_row")
