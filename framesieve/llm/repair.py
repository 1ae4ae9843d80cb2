"""Re-Pair grammar compression of id sequences, in numpy, and the shard format that holds it.

Each round counts all adjacent pairs of the sequence, makes nonterminals of the most frequent ones and replaces their
occurrences, until no pair is frequent.  Rules of a round name only ids and nonterminals of earlier rounds, so decoding undoes
the rounds in turn.  Shards keep rules, expansion lengths and the expanded offset of every block of symbols, which lets a
reader decode any range of ids without the rest.  Symbols take as many bits as the last nonterminal's number needs; a
block of them fills whole bytes.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIIIQQ")  # magic, first nonterminal, rules, documents, bits of a length, symbols, ids
BLOCK = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A reader expands the shorter nonterminals of a shard once, so many ids in all, and longer ones where they stand.
EXPANDED = 1 << 21


def _apart(at: np.ndarray) -> np.ndarray:
    """Of ascending places, every second one of those next to each other, from the left."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1] + 1
    order = np.arange(len(at))
    return (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in that order), keys of that many bits: sorted as one number each, key and place, where these fit 64 bits."""
    place = len(keys).bit_length()
    if bits + place > 64:
        order = np.argsort(keys)
        return order, keys[order]
    both = np.sort(keys << np.uint64(place) | np.arange(len(keys), dtype=np.uint64))
    order = (both & np.uint64((1 << place) - 1)).view(np.int64)
    both >>= np.uint64(place)
    return order, both


def compress(ids: np.ndarray, first: int, rounds: int | None = None, per_round: int = 2048, least: int = 4):
    """(symbols, rules): rules[k] is the pair that nonterminal first + k stands for.

    Rounds go on until no pair occurs least times, or for at most rounds of them.
    """
    seq = np.array(ids, np.uint32)
    rules, made = [np.zeros((0, 2), np.uint32)], 0
    live = np.arange(max(0, len(seq) - 1))  # places whose pair may occur least times; counts of old pairs only fall
    while len(live) and (rounds is None or rounds > 0):
        rounds = None if rounds is None else rounds - 1
        left, right = seq[live], seq[live + 1]
        # Occurrences in a run of one symbol overlap, so every second one counts.
        same = np.flatnonzero(left == right)
        if len(same):
            counts_here = np.ones(len(live), bool)
            counts_here[same] = _apart(live[same])
            skipped = live[~counts_here]
            live, left, right = live[counts_here], left[counts_here], right[counts_here]
        else:
            skipped = live[:0]
        half = (first + made).bit_length()
        order, ordered = _sorted(left.astype(np.uint64) << np.uint64(half) | right, 2 * half)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sizes = np.diff(np.append(starts, len(ordered)))
        frequent = np.flatnonzero(sizes >= least)
        if not len(frequent):
            break
        top = frequent
        if len(top) > per_round:
            top = top[np.argpartition(sizes[top], -per_round)[-per_round:]]
        # Equal counts in mixed order: of the pairs of a long repeat, one in three or so wins then, in order only the first.
        top = top[np.lexsort((ordered[starts[top]] * _MIX, -sizes[top]))]
        group_rank = np.where(sizes >= least, len(top), len(top) + 1).astype(np.int32)
        group_rank[top] = np.arange(len(top), dtype=np.int32)
        rank = np.empty(len(live), np.int32)
        rank[order] = np.repeat(group_rank, sizes)
        chosen = np.flatnonzero(rank < len(top))
        at, of = live[chosen], rank[chosen]
        # Of places that overlap the more frequent pair is replaced, so the first pair of all is replaced everywhere.
        wins = np.ones(len(at), bool)
        touch = np.flatnonzero(at[1:] == at[:-1] + 1)
        wins[touch[of[touch] > of[touch + 1]]] = False
        wins[touch[of[touch] < of[touch + 1]] + 1] = False
        at, of = at[wins], of[wins]
        used = np.bincount(of, minlength=len(top)) >= least
        at, of = at[used[of]], of[used[of]]
        name = np.cumsum(used) - 1
        pair = ordered[starts[top[used]]]
        rules.append(np.stack((pair >> np.uint64(half), pair & np.uint64((1 << half) - 1)), 1).astype(np.uint32))
        seq[at] = first + made + name[of]
        made += len(pair)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        # Live stay the places of frequent pairs; new are the two pairs of each new symbol.
        alive = np.zeros(len(seq) + 1, bool)
        alive[live[rank <= len(top)]] = True
        alive[skipped] = True
        alive[at] = True
        alive[at - 1] = True  # of place 0 the spare last cell
        back = at[at > 1]
        back = back[~keep[back - 1]]
        alive[back - 2] = True  # the symbol before was made in this round too
        alive = alive[:-1][keep]
        alive[-1:] = False
        seq = seq[keep]
        live = np.flatnonzero(alive)
    return seq, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for, found for all rules at once that name only earlier ones."""
    lengths = np.ones(first + len(rules), np.int64)
    newest, low = rules.max(axis=1, initial=0), 0
    while low < len(rules):
        late = np.flatnonzero(newest[low:] >= first + low)
        high = low + int(late[0]) if len(late) else len(rules)
        lengths[first + low : first + high] = lengths[rules[low:high]].sum(axis=1)
        low = high
    return lengths[first:]


def _split(seq: np.ndarray, at: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """seq with the pairs that the nonterminals at these places stand for."""
    pairs = rules[seq[at] - np.uint32(first)]
    width = np.ones(len(seq), np.int64)
    width[at] = 2
    start = np.cumsum(width) - width
    out = np.repeat(seq, width)
    out[start[at]] = pairs[:, 0]
    out[start[at] + 1] = pairs[:, 1]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(seq >= first)):
        seq = _split(seq, at, rules, first)
    return seq


def symbol_bits(first: int, n_rules: int) -> int:
    return max(1, first + n_rules - 1).bit_length()


def pack(values: np.ndarray, bits: int) -> bytes:
    """values of that many bits each, highest bit first."""
    wide = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(raw: np.ndarray, bits: int, count: int) -> np.ndarray:
    """count values of that many bits each; eight of them fill as many bytes as one has bits."""
    rows = np.zeros((-(-count // 8), bits), np.uint8)
    used = -(-count * bits // 8)
    rows.ravel()[:used] = raw[:used]
    columns = rows.T.astype(np.uint64)  # a value of 32 bits may lie in five bytes
    out = np.empty((len(rows), 8), np.uint32)
    for k in range(8):
        low, high = k * bits // 8, -(-(k + 1) * bits // 8)
        value = columns[low]
        for column in columns[low + 1 : high]:
            value = value << np.uint64(8) | column
        out[:, k] = value >> np.uint64(8 * high - (k + 1) * bits) & np.uint64((1 << bits) - 1)
    return out.ravel()[:count]


def encode_shard(ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, known: np.ndarray, first: int, **tune) -> bytes:
    """One shard: ids of documents in a row, how many each has, their keys and whether the key is not null."""
    symbols, rules = compress(ids, first, **tune)
    lengths = rule_lengths(rules, first)
    wide = np.ones(len(symbols), np.int64)
    named = symbols >= first
    wide[named] = lengths[symbols[named] - np.uint32(first)]
    starts = np.cumsum(wide) - wide
    bits, width = symbol_bits(first, len(rules)), int(lengths.max(initial=1)).bit_length()
    parts = [
        _HEAD.pack(MAGIC, first, len(rules), len(counts), width, len(symbols), len(ids)),
        pack(rules.ravel(), bits),
        pack(lengths, width),
        starts[::BLOCK].astype("<u8").tobytes(),
        np.asarray(keys, "<i8").tobytes(),
        np.asarray(known, "u1").tobytes(),
        np.asarray(counts, "<u8").tobytes(),
        pack(symbols, bits),
    ]
    return b"".join(parts)


class Shard:
    """A shard's bytes, read in parts."""

    def __init__(self, raw: bytes):
        magic, self.first, n_rules, n_docs, width, n_symbols, self.n_ids = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        self.bits = symbol_bits(self.first, n_rules)
        self.rules = unpack(take("u1", -(-2 * n_rules * self.bits // 8)), self.bits, 2 * n_rules).reshape(-1, 2)
        self.lengths = unpack(take("u1", -(-n_rules * width // 8)), width, n_rules)
        self.blocks = take("<u8", -(-n_symbols // BLOCK)).astype(np.int64)
        self.keys, self.known = take("<i8", n_docs), take("u1", n_docs)
        self.counts = take("<u8", n_docs).astype(np.int64)
        self.n_symbols, self.packed = n_symbols, take("u1", -(-n_symbols * self.bits // 8))
        by_length = np.argsort(self.lengths, kind="stable")
        short = by_length[np.cumsum(self.lengths[by_length], dtype=np.int64) <= EXPANDED]
        short.sort()
        #: The ids of every id and short nonterminal in a row, and where and how many those of each symbol are: none of a long one.
        ids = expand(short + self.first, self.rules, self.first)
        self.flat = np.concatenate((np.arange(self.first, dtype=np.uint32), ids))
        self.width = np.zeros(self.first + n_rules, np.int64)
        self.width[: self.first] = 1
        self.width[short + self.first] = self.lengths[short]
        self.place = np.cumsum(self.width) - self.width

    def symbols(self, low: int, high: int) -> np.ndarray:
        """The symbols of blocks low to high."""
        count = min(high * BLOCK, self.n_symbols) - low * BLOCK
        return unpack(self.packed[low * BLOCK * self.bits // 8 : -(-high * BLOCK * self.bits // 8)], self.bits, count)

    def decode(self, start: int, length: int) -> np.ndarray:
        """ids[start : start + length] of the shard, from the blocks that hold them."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(self.blocks, start, "right")) - 1
        high = int(np.searchsorted(self.blocks, start + length, "left"))
        ids = self._ids(low, high)
        skip = start - int(self.blocks[low])
        return ids[skip : skip + length]

    def all_ids(self) -> np.ndarray:
        return self._ids(0, len(self.blocks))

    def _ids(self, low: int, high: int) -> np.ndarray:
        """The ids of blocks low to high."""
        seq = self.symbols(low, high)
        while len(at := np.flatnonzero(self.width[seq] == 0)):
            seq = _split(seq, at, self.rules, self.first)
        width = self.width[seq]
        start = np.cumsum(width) - width
        return self.flat[np.repeat(self.place[seq] - start, width) + np.arange(width.sum())]
