"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which of them overlap.

Pass one tokenises each text with both and stores the ids.  The byte offsets where tokens end are two ascending lists.  The
shorter list of a document drives a galloping search (steps that double, then bisection) into the longer one, which gives
each of its ends a rank there; common ends cut the tokens into groups, differences of ranks are the ranges of tokens that
overlap.  The search runs for all documents of a batch at once, in numpy.  Each task counts its linked id pairs before
they are shuffled.

Pass two needs the counts of all pairs for every link.  They are sent to the tasks in blocks of a fixed number of pairs,
one pass over the stored ids for each block; a vocabulary pair with few distinct links needs one.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes
from .tokens import ChunkEncoder, _cells, slices

#: What sentencepiece writes for a blank.
BLANK = "▁"
#: A blank or several and what follows them; no piece has a blank behind another character, so none reaches over this border.
_PIECES = re.compile(rb" +[^ ]*")

DOCS = "doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STORED = DOCS + ", pair long, links long"
COUNTED = DOCS + ", n_best long, count_sum long"

_WORKER: dict = {}


class PieceEncoder:
    """Ids of texts that begin with the blank the model adds; the ids of at most max_chunks chunks are remembered."""

    def __init__(self, path: str, max_chunks: int = 400_000, max_chunk_bytes: int = 60):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.model.vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.blank = [self.model.piece_to_id(BLANK)]
        self.known: dict[bytes, bytes | None] = {}
        self.max_chunks, self.max_chunk_bytes = max_chunks, max_chunk_bytes
        self.bytes_of = [self._bytes(i) for i in range(self.model.vocab_size())]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode()

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of chunks; None where the pieces' bytes are not the chunk's."""
        found = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
        for chunk, ids in zip(chunks, found):
            ids = ids or self.blank  # the model adds no blank to an empty text
            same = b"".join(map(self.bytes_of.__getitem__, ids)) == chunk
            self.known[chunk] = array("H", ids).tobytes() if same else None

    def encode(self, texts: list[bytes]) -> list[bytes | None]:
        """Little-endian 16-bit ids of each text, None where joined pieces are not the text.  Texts begin with a blank."""
        if len(self.known) > self.max_chunks:
            self.known.clear()
        cells = pa.array([t[1:] for t in texts], pa.large_binary()).cast(pa.large_string())
        single = pc.split_pattern(cells, " ")
        ends = single.offsets.to_numpy().astype(np.int64)
        flat = single.flatten().dictionary_encode()
        at, chunks = flat.indices.to_numpy().astype(np.int64), [b" " + c for c in _cells(flat.dictionary)]
        new = [c for c in chunks if c not in self.known]
        self._learn(new)
        ids = [self.known[c] for c in chunks]
        odd = pc.match_substring_regex(cells, r"^ |  ").to_numpy(zero_copy_only=False)
        broken = np.zeros(len(texts), bool)
        if None in ids:
            none = np.fromiter((x is None for x in ids), bool, len(ids))
            broken = np.logical_or.reduceat(none[at], ends[:-1])
            ids = [x or b"" for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        known = np.frombuffer(b"".join(ids), "<u2")
        starts, width = np.cumsum(sizes) - sizes, sizes[at]
        total = np.concatenate(([0], np.cumsum(width)))
        out = known[np.repeat(starts[at] - total[:-1], width) + np.arange(total[-1])].tobytes()
        bounds = (2 * total[ends]).tolist()
        found: list[bytes | None] = [out[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd).tolist():  # blanks in a row belong to one chunk
            parts = _PIECES.findall(texts[i])
            self._learn([c for c in dict.fromkeys(parts) if c not in self.known])
            ids = [self.known[c] for c in parts]
            broken[i] = None in ids
            found[i] = b"" if broken[i] else b"".join(ids)
        for i in np.flatnonzero(broken).tolist():
            found[i] = None
        for c in new:
            if len(c) > self.max_chunk_bytes:
                self.known.pop(c, None)
        return found


def _byte_encoder(path: str) -> ChunkEncoder:
    coder = ChunkEncoder(path, byte_level=True)
    coder.tokenizer.encode_special_tokens = True  # their strings are plain text
    back = {letter: byte for byte, letter in coder.letters.items()}
    sizes = np.zeros(coder.tokenizer.get_vocab_size(), np.int64)
    for token, i in coder.tokenizer.get_vocab().items():
        sizes[i] = len(token) if all(x in back for x in token) else len(token.encode())
    coder.sizes = sizes
    if coder.code != "H":
        raise ValueError("ids must fit 16 bits")
    return coder


def _coders(path_a: str, path_b: str):
    """One pair of encoders per worker process."""
    if (path_a, path_b) not in _WORKER:
        _WORKER[path_a, path_b] = _byte_encoder(path_a), PieceEncoder(path_b)
    return _WORKER[path_a, path_b]


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """The rank of each value of short in long (how many values there are smaller); both ascend.

    From its guess each value steps away by 1, 2, 4, ... until the rank lies between, and bisects what is left.
    """
    n = len(long)
    if not n:
        return np.zeros(len(short), np.int64)
    low = np.clip(guess, 0, n - 1)
    high = low + 1  # the rank is in [low, high] once long[low - 1] < value <= long[high]
    up = long[low] < short
    # Upwards: low stays a value known to be smaller, high runs ahead.
    step, active = 1, np.flatnonzero(up)
    low[active] += 1
    high[active] = low[active]
    while len(active):
        ahead = np.minimum(high[active], n)
        done = (ahead == n) | (long[np.minimum(ahead, n - 1)] >= short[active])
        high[active] = ahead
        active = active[~done]
        low[active] = high[active] + 1
        high[active] = low[active] + step - 1
        step *= 2
    # Downwards: high stays a value known not to be smaller.
    step, active = 1, np.flatnonzero(~up)
    high[active] = low[active]
    while len(active):
        behind = high[active] - step
        done = (behind < 0) | (long[np.maximum(behind, 0)] < short[active])
        low[active] = np.where(done, np.maximum(behind + 1, 0), low[active])
        high[active] = np.where(done, high[active], behind)
        active = active[~done]
        step *= 2
    while True:
        active = np.flatnonzero(low < high)
        if not len(active):
            return low
        middle = (low[active] + high[active]) // 2
        smaller = long[middle] < short[active]
        low[active] = np.where(smaller, middle + 1, low[active])
        high[active] = np.where(smaller, high[active], middle)


class Alignment:
    """Groups and links of a batch of documents.  a and b are the ids of all, counts the number of each document's."""

    def __init__(self, a, b, counts_a, counts_b, sizes_a, sizes_b):
        self.a, self.b = a, b
        self.counts_a, self.counts_b = counts_a, counts_b
        # Document after document, so that the ends of all of them ascend.
        ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        base_a, base_b = np.cumsum(counts_a) - counts_a, np.cumsum(counts_b) - counts_b
        low, n = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        common_a, common_b = [], []
        first, partners, flip = [], [], []
        for a_drives in (True, False):
            chosen = np.flatnonzero((counts_a <= counts_b) == a_drives)
            x, y = (ends_a, ends_b) if a_drives else (ends_b, ends_a)
            cx, cy = (counts_a, counts_b) if a_drives else (counts_b, counts_a)
            bx, by = (base_a, base_b) if a_drives else (base_b, base_a)
            nx = cx[chosen]
            doc = np.repeat(chosen, nx)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(nx) - nx, nx)  # place in the document
            driver = bx[doc] + at
            rank = gallop(x[driver], y, by[doc] + at * cy[doc] // np.maximum(cx[doc], 1))
            same = y[rank] == x[driver]
            # A token reaches from the token that holds its start to the token that holds its end.
            before = np.where(at > 0, np.concatenate(([0], (rank + same)[:-1])), by[doc])
            first.append(before)
            partners.append(rank - before + 1)
            flip.append((driver, a_drives))
            common_a.append(driver[same] if a_drives else rank[same])
            common_b.append(rank[same] if a_drives else driver[same])
        self.common_a, self.common_b = np.sort(np.concatenate(common_a)), np.sort(np.concatenate(common_b))
        left, right, docs = [], [], []
        for (driver, a_drives), start, number in zip(flip, first, partners):
            one = np.repeat(driver, number)
            other = np.repeat(start - (np.cumsum(number) - number), number) + np.arange(number.sum())
            left.append(one if a_drives else other)
            right.append(other if a_drives else one)
        #: Places of the A and B tokens of each link.
        self.link_a, self.link_b = np.concatenate(left), np.concatenate(right)
        self.base_a = base_a

    def per_doc(self, places_a: np.ndarray, weights=None) -> np.ndarray:
        """How many of the A places, or the sum of their weights, each document has."""
        whole = np.concatenate((self.base_a, [len(self.a)]))
        held = np.zeros(len(self.a) + 1, np.int64)
        np.add.at(held, places_a + 1, 1 if weights is None else weights)
        summed = np.cumsum(held)
        return summed[whole[1:]] - summed[whole[:-1]]

    def pairs(self) -> np.ndarray:
        """B id and A id of each link in one number."""
        return self.b[self.link_b].astype(np.uint32) << np.uint32(16) | self.a[self.link_a].astype(np.uint32)

    def written(self) -> list[bytes]:
        """Each document's groups as text: ids with commas, | between A and B, ; between groups."""
        cut_a, cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        cut_a[self.common_a], cut_b[self.common_b] = True, True
        # Tokens in the order written: groups before a token, then A before B.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        behind_b, behind_a = np.concatenate(([0], self.common_b + 1)), np.concatenate((self.common_a + 1, [len(self.a)]))
        place_a = np.arange(len(self.a)) + behind_b[group_a]
        place_b = np.arange(len(self.b)) + behind_a[group_b]
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.uint16), np.empty(n, np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a], mark[place_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
        digits, width = _decimals()
        cells = np.empty((n, 6), np.uint8)
        cells[:, :5] = digits[ids]
        cells[:, 5] = mark
        shown = np.empty((n, 6), bool)
        shown[:, :5] = np.arange(5) >= 5 - width[ids][:, None]
        shown[:, 5] = True
        flat = cells[shown].tobytes()
        total = np.concatenate(([0], np.cumsum(width[ids] + 1)))
        ends = total[np.cumsum(self.counts_a + self.counts_b)]
        starts = np.concatenate(([0], ends[:-1]))
        return [flat[s : e - 1] for s, e in zip(starts.tolist(), ends.tolist())]  # without the last mark


def _decimals():
    """Five digits of every 16-bit number and how many of them it has."""
    if "decimals" not in _WORKER:
        n = np.arange(1 << 16)
        digits = (n[:, None] // 10 ** np.arange(4, -1, -1) % 10 + ord("0")).astype(np.uint8)
        _WORKER["decimals"] = digits, np.searchsorted([10, 100, 1000, 10000], n, "right") + 1
    return _WORKER["decimals"]


class _PairCounts:
    """Links of each pair so far, in sorted arrays that are merged now and then."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, pairs: np.ndarray):
        self.parts.append(np.unique(pairs, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size >= self.most:
            self._merge()
            if self.size >= self.most // 2:
                return self.take()
        return None

    def _merge(self):
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[head], np.add.reduceat(counts, head))]
        self.size = len(head)

    def take(self):
        if not self.parts:
            return None
        self._merge()
        found, self.parts, self.size = self.parts[0], [], 0
        return found


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    rows = max(map(len, columns.values()))
    arrays, names = [], []
    for field in schema.split(", "):
        name, kind = field.split()
        arrays.append(pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(rows, kinds[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _joined(ids: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
    return np.frombuffer(b"".join(ids), "<u2"), counts


def _align(path_a: str, path_b: str):
    def run(batches):
        coder_a, coder_b = _coders(path_a, path_b)
        held = _PairCounts()

        def pairs(found):
            return _batch({"pair": found[0].astype(np.int64), "links": found[1]}, STORED)

        for batch in batches:
            keys, done = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1)):
                some = [i for i, t in enumerate(texts) if t]
                spaced = [b" " + texts[i] for i in some]
                ids_a, ids_b = coder_a.encode(spaced) if some else [], coder_b.encode(spaced) if some else []
                a, b = [b""] * len(texts), [b""] * len(texts)
                for i, x, y, raw in zip(some, ids_a, ids_b, spaced):
                    if y is not None and coder_a.sizes[np.frombuffer(x, "<u2")].sum() == len(raw):
                        a[i], b[i] = x, y
                (flat_a, n_a), (flat_b, n_b) = _joined(a), _joined(b)
                found = Alignment(flat_a, flat_b, n_a, n_b, coder_a.sizes, coder_b.sizes)
                shown = ["" if not n else hashlib.sha256(x).hexdigest() for n, x in zip(n_a.tolist(), found.written())]
                full = held.add(found.pairs()) if len(found.link_a) else None
                if full:
                    yield pairs(full)
                yield _batch(
                    {
                        "doc_id": keys[done : done + len(texts)],
                        "a": a,
                        "b": b,
                        "n_a": n_a,
                        "n_b": n_b,
                        "n_groups": found.per_doc(found.common_a),
                        "n_links": found.per_doc(found.link_a),
                        "groups_sha256": shown,
                    },
                    STORED,
                )
                done += len(texts)
        full = held.take()
        if full:
            yield pairs(full)

    return run


def _add_counts(path_a: str, path_b: str, block):
    """Adds what the links of a block's pairs contribute.  block: sorted pairs, their counts, whether best of their B id."""

    def run(batches):
        coder_a, coder_b = _coders(path_a, path_b)
        keys, counts, best = block.value
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64)
            held = np.cumsum(sizes) // 2_000_000  # rows whose ids stay below a bound
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(held)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(int(part[0]), len(part))
                (a, n_a), (b, n_b) = _joined(rows.column(1).to_pylist()), _joined(rows.column(2).to_pylist())
                found = Alignment(a, b, n_a, n_b, coder_a.sizes, coder_b.sizes)
                pairs, back = np.unique(found.pairs(), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                hit = keys[at] == pairs
                sums = rows.column(9).to_numpy() + found.per_doc(found.link_a, np.where(hit, counts[at], 0)[back])
                bests = rows.column(8).to_numpy() + found.per_doc(found.link_a, (hit & best[at]).astype(np.int64)[back])
                names = rows.schema.names
                columns = [*rows.columns[:8], pa.array(bests, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = 2_000_000) -> DataFrame:
    """(doc_id, a, b, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of docs.

    docs needs doc_id and text; other columns are left out.  a and b are the ids (16 bits, little-endian) by a byte-level
    vocabulary and a sentencepiece model.  A null or empty text, and one that either vocabulary does not give back byte by
    byte, has no tokens, zeros and an empty hash.  Rows that repeat a document count each; an empty table gives none.
    n_best: links whose pair is the most frequent of its B id, all of those that tie; count_sum: counts of all links' pairs.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    first = stored(narrow.mapInArrow(_align(path_a, path_b), STORED), "aligned")
    counts = first.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("links").alias("links"))
    # The most frequent pair of a B id: an aggregate, joined back, so that no B id's pairs meet in one task.
    counts = stored(counts, "pair-counts").withColumn("b", F.shiftright("pair", 16))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    ranked = counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    ranked = stored(ranked, "pair-counts")
    blocks = max(1, -(-ranked.count() // block_pairs))
    df = first.where(F.col("pair").isNull()).drop("pair", "links")
    zero = F.lit(0).cast("long")
    df = df.withColumn("n_best", zero).withColumn("count_sum", zero)
    for number in range(blocks):
        part = ranked.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == number).toArrow()
        if not len(part):
            continue
        order = np.argsort(part["pair"].to_numpy(), kind="stable")
        block = tuple(part[c].to_numpy()[order] for c in ("pair", "links", "best"))
        sent = spark.sparkContext.broadcast((block[0].astype(np.uint32), block[1], block[2]))
        df = df.mapInArrow(_add_counts(path_a, path_b, sent), COUNTED)
        if blocks > 1:  # one block's table in a worker at a time
            df = stored(df, "aligned")
            sent.unpersist()
    return df
