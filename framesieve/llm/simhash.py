"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits.  The bits are dealt into groups, bits that agree or differ together into the same one, and
group i gets a threshold t_i with sum(t_i) = limit - groups + 1 (-1 leaves a group out).  Two fingerprints within limit
bits then agree, in at least one group, up to its threshold.  So every distinct fingerprint is indexed once per group
under its exact value there and probes all values within the threshold; whatever meets is verified on all 64 bits.  The
number of groups and the thresholds come from a dynamic program over estimated candidate and probe counts; they decide the
cost alone, never the result.

Meetings in one bucket are not written out as pairs: a bucket yields a spanning forest of its links, at most one link per
member.  Buckets beyond a size are dealt into blocks, and every pair of blocks is visited by a task of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, hash_sample, stored, text_bytes
from .components import components

BITS = 64


# -- fingerprints ------------------------------------------------------------------------------------------------------


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text in UTF-8: bit b is 1 if over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest as digest

    words = raw.translate(LOWER_ASCII).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return digest(flat, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(flat[a:b], seed) for a, b in spans], ">u8")
    total = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        block = hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _fingerprints(width: int, seed: int):
    def run(batches):
        for batch in batches:
            values = [fingerprint(x.as_py() or b"", width, seed) for x in batch.column(1)]
            marks = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the 64-bit pattern as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    return rows.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


# -- bit groups and thresholds -----------------------------------------------------------------------------------------


def _bit_matrix(sample: np.ndarray) -> np.ndarray:
    return np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_groups(sample: np.ndarray, count: int) -> list[list[int]]:
    """The 64 bit places (0 is the highest) in count groups of near-equal size, correlated bits together."""
    bits = _bit_matrix(sample).astype(np.float64)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).mean(axis=0))
    spread[spread == 0] = np.inf
    tied = np.abs((centred.T @ centred) / max(len(sample), 1) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = set(range(BITS)), []
    for g in range(count):
        size = BITS // count + (g < BITS % count)
        rest = sorted(free)
        group = [rest[int(np.argmax(tied[np.ix_(rest, rest)].sum(axis=1)))]]
        free.remove(group[0])
        while len(group) < size:
            rest = sorted(free)
            group.append(rest[int(np.argmax(tied[np.ix_(rest, group)].sum(axis=1)))])
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius bits of width."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def group_values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, gathered into one number each."""
    fps = fps.astype(np.uint64)
    out = np.zeros(len(fps), np.uint64)
    for place in group:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(63 - place)) & np.uint64(1))
    return out


def _estimate(sample: np.ndarray, group: list[int], total: int, radius: int) -> float:
    """Estimated candidates of all total fingerprints in a group at a radius, from a sample's pairs."""
    if radius < 0:
        return 0.0
    values, counts = np.unique(group_values(sample, group), return_counts=True)
    met = 0.0
    for mask in _ball(len(group), radius):
        at = np.searchsorted(values, values ^ np.uint64(mask))
        at[at == len(values)] = 0
        met += float((counts * counts[at] * (values[at] == values ^ np.uint64(mask))).sum())
    met -= len(sample)  # each with itself
    # A sample that shows no meeting still leaves the share that uniform bits would have.
    least = len(sample) ** 2 * len(_ball(len(group), radius)) / 2.0 ** len(group)
    return max(met, least) * (total / max(len(sample), 1)) ** 2


def plan(sample: np.ndarray, total: int, limit: int = 4, row_cost: float = 300.0, most_rows: int = 64):
    """(groups, thresholds) of the least estimated cost.

    row_cost is what one index or probe row costs, in verifications of a candidate.  No plan writes more than most_rows
    rows per fingerprint.
    """
    best = None
    for count in range(2, limit + 2):
        groups = bit_groups(sample, count)
        need = limit - count + 1
        # cost[s]: least cost of the groups so far with thresholds that add up to s.
        cost: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
        for group in groups:
            step: dict[int, tuple[float, int, list[int]]] = {}
            for radius in range(-1, limit + 1):
                rows = len(_ball(len(group), radius)) if radius >= 0 else 0
                if rows > most_rows:
                    continue
                price = _estimate(sample, group, total, radius) + row_cost * total * rows
                for s, (paid, used, chosen) in cost.items():
                    got = (paid + price, used + rows, [*chosen, radius])
                    if got[1] <= most_rows and (s + radius not in step or got < step[s + radius]):
                        step[s + radius] = got
            cost = step
        if need in cost and (best is None or cost[need][0] < best[0]):
            best = (cost[need][0], groups, cost[need][2])
    return best[1], best[2]


# -- index, probe, verify ----------------------------------------------------------------------------------------------


def _keys(groups, thresholds):
    masks = []
    for group, radius in zip(groups, thresholds):
        around = _ball(len(group), radius) if radius >= 0 else []
        masks.append(np.array(around, np.uint64))

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for g, group in enumerate(groups):
                own = group_values(fps, group)
                for k, mask in enumerate(masks[g].tolist()):
                    keys = ((own ^ np.uint64(mask)) << np.uint64(3) | np.uint64(g)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.full(len(fps), k > 0)), batch.column(0)], ["key", "probe", "fp"]
                    )

    return run


def _near(one: np.uint64, many: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= limit


def bucket_links(owners: np.ndarray, probers: np.ndarray, limit: int):
    """Links that join all owners and probers of a bucket which links between two owners or a prober and an owner join.

    The walk goes from a member to all unvisited members within limit, so each member is reached once; a dense bucket is
    done after few steps, and a bucket of strangers takes one comparison per pair.
    """
    fps = np.concatenate((owners, probers))
    owns = np.zeros(len(fps), bool)
    owns[: len(owners)] = True
    rest = np.arange(len(fps))
    links = []
    while len(rest) > 1:
        front = [int(rest[0])]
        rest = rest[1:]
        while front and len(rest):
            here = front.pop()
            hit = _near(fps[here], fps[rest], limit)
            if not owns[here]:
                hit &= owns[rest]
            found = rest[hit]
            if len(found):
                links.extend((here, x) for x in found.tolist())
                front.extend(found.tolist())
                rest = rest[~hit]
        if not owns[rest].any():
            break
    return [(int(fps[a]), int(fps[b])) for a, b in links]


def _verify(limit: int):
    """Takes rows sorted by bucket; a bucket may run over several batches."""

    def links(fps, probe):
        if len(fps) < 2 or probe.all():
            return []
        return bucket_links(fps[~probe], fps[probe], limit)

    def run(batches):
        held: list[tuple] = []
        key = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            block = batch.column(1).to_numpy()
            probe = batch.column(2).to_numpy(zero_copy_only=False)
            fps = batch.column(3).to_numpy().view(np.uint64)
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (block[1:] != block[:-1])) + 1
            starts = np.concatenate(([0], cut)) if len(keys) else np.zeros(0, int)
            ends = np.append(cut, len(keys))
            out: list[tuple[int, int]] = []
            first = (int(keys[0]), int(block[0])) if len(keys) else key
            if held and first != key:
                out += links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                held = []
            big = (ends - starts) > 1
            big[[0, -1]] = True  # these may belong to what came before or comes after
            for a, b in zip(starts[big].tolist(), ends[big].tolist()):
                if a == 0 and held:
                    held.append((fps[a:b], probe[a:b]))
                    if b < len(keys):
                        out += links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                        held = []
                elif b == len(keys):
                    held = [(fps[a:b], probe[a:b])]
                else:
                    out += links(fps[a:b], probe[a:b])
            if len(keys):
                key = (int(keys[-1]), int(block[-1]))
            yield _link_batch(out)
        if held:
            yield _link_batch(links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))

    return run


def _link_batch(links):
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])


def links(distinct: DataFrame, limit: int = 4, sample_rows: int = 20_000, most_bucket: int = 20_000) -> DataFrame:
    """(x, y): fingerprints within limit bits, enough of them to join all that are linked.

    distinct has one column fp without repeats.  sample_rows bounds what the planner sees; it sets the cost alone.
    Buckets of more than most_bucket rows are dealt into blocks, and each pair of blocks is a bucket of its own.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    if total < 2:
        return spark.createDataFrame([], "x long, y long")
    picked = hash_sample(distinct, ["fp"], sample_rows, total).toPandas()["fp"].to_numpy().view(np.uint64)
    groups, thresholds = plan(np.sort(picked), total, limit)
    keyed = distinct.mapInArrow(_keys(groups, thresholds), "key long, probe boolean, fp long")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_bucket)
    large = stored(large.withColumn("blocks", F.ceil(F.col("n") / (most_bucket / 2)).cast("int")), "large-buckets")
    rows = keyed.withColumn("block", F.lit(0))
    n_large, most = large.agg(F.count("*"), F.max("blocks")).first()
    if n_large:
        # Every row of a large bucket has a block b and goes to the pairs (b, other), so any two rows meet once or more.
        side = large.select("key", "blocks")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = keyed.join(side, "key").withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.least("own", "other") * F.lit(most) + F.greatest("own", "other") + 1
        dealt = dealt.select("key", "probe", "fp", pair.cast("int").alias("block"))
        rows = rows.join(side.select("key"), "key", "left_anti").select("key", "probe", "fp", "block").union(dealt)
    met = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return met.select("key", "block", "probe", "fp").mapInArrow(_verify(limit), "x long, y long")


def classes(marks: DataFrame, limit: int = 4) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of marks (doc_id, fp): the least doc_id that links reach.

    Links join fingerprints, so rows without doc_id connect others as all rows do.
    """
    least = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    found = stored(links(least.select("fp"), limit), "fingerprint-links")
    joined = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = least.join(joined, least["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = stored(named, "fingerprint-classes")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(ids, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, limit: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    docs needs doc_id and text; other columns are left out.  Null, empty and wordless texts have fingerprint 0 and link
    to whatever else lies within limit bits of it.  A row without doc_id connects others and gets the component of its
    fingerprint, but never names one; if no row of a component has an id, component_id is null.  Repeated rows come back
    repeated.
    """
    marks = stored(fingerprints(docs, width, seed), "fingerprints")
    found = classes(marks, limit)
    return marks.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, seed: int = 42, limit: int = 4) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the least doc_id stays.

    All columns of docs are kept.  Rows without doc_id always stay; of rows that repeat the least doc_id all stay.
    """
    found = near_duplicates(docs, width, seed, limit)
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
