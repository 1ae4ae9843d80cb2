"""Personal data: fixed patterns, and a bidirectional LSTM with CRF transitions that finds what they miss.

The patterns give the base spans.  The model is trained on the driver from a bounded sample of excerpts with labelled spans:
the base spans as they stand, the same data in forms that the patterns do not know (other separators, spelled-out signs),
and secrets, such as keys and tokens, written into the excerpts.  It reads every stretch that can hold a span: all kinds
hold a digit, an at sign or a spelled-out one, so a span lies within reach of one, and text without any has no other
tagging than O.  Stretches are cut into overlapping windows; the emissions of windows that overlap are blended, each
weighted by its distance from the window's border, and one decoding over the whole stretch reconciles them.  Spans of the
model are added where no base span is and where what they hold can be of their kind.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample
from .tagger import PAD, Tagger, char_ids

# The kinds in their order (the last one without a pattern) and the characters of the patterns.
KINDS = ["email", "ip", "card", "phone", "secret"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_BASE = re.compile(r"[0-9@]")
_AT = re.compile(r"\s*(?:@|\(at\)|\[at\])\s*")
_DOT = re.compile(r"\s*(?:\.|\(dot\)|\[dot\])\s*")
WINDOW, STRIDE, REACH = 64, 32, 32


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text):
    """Leftmost matches, found from each at sign so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text):
    for run in _NUMBERS.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; places in code points, end exclusive."""
    if not _BASE.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)] + [(a, b, 1) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if m.end() - m.start() < 60 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span can be: all places within reach of a digit or an at sign."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _windows(size: int) -> list[int]:
    if size <= WINDOW:
        return [0]
    return [*range(0, size - WINDOW, STRIDE), size - WINDOW]


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)


def _fits(text: str, kind: int) -> bool:
    """Whether what a span of the model holds can be of its kind, however it is written."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == 0:
        sides = _AT.split(text)
        return len(sides) == 2 and len(_DOT.split(sides[1])) > 1 and not re.search(r"\s", _DOT.sub(".", "@".join(sides)))
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9 .,()\[\]]", text)
    if kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits) and not re.search(r"[^0-9 ./_-]", text)
    if kind == 3:
        apart = len(re.findall(r"[0-9]+", text)) > 2 or text[0] in "+("
        return 10 <= len(digits) <= 15 and apart and not re.search(r"[^\x20+()./0-9-]", text) and text[0] in "+(0123456789"
    if not re.fullmatch(r"[A-Za-z0-9_+/=-]{16,}", text) or len(set(text)) < 8:
        return False
    # Digits, small and large letters by turns: no word and no number alone.
    kinds = [c.isdigit() + 2 * c.isupper() for c in text]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 4 and any(map(str.isdigit, text))


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1] in " .,;:!?\n\t":
        b -= 1
    return a, b


def model_spans(model: Tagger, texts: list[str], most_windows: int = 1024) -> list[list[tuple[int, int, int]]]:
    """The spans that the model finds in each text."""
    todo = [(i, a, b) for i, text in enumerate(texts) for a, b in stretches(text)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    low = 0
    while low < len(todo):
        high, count = low, 0
        while high < len(todo) and (high == low or count < most_windows):
            count += len(_windows(todo[high][2] - todo[high][1]))
            high += 1
        for (i, a, _), tags in zip(todo[low:high], _decoded(model, texts, todo[low:high], most_windows)):
            found[i] += [(a + s, a + e, kind) for s, e, kind in _runs(tags)]
        low = high
    return found


def _decoded(model, texts, group, most_windows):
    ids, place = [], []
    for n, (i, a, b) in enumerate(group):
        whole = char_ids(texts[i][a:b])
        for w in _windows(b - a):
            part = whole[w : w + WINDOW]
            ids.append(np.pad(part, (0, WINDOW - len(part)), constant_values=PAD))
            place.append((n, w))
    scores = []
    for low in range(0, len(ids), most_windows):
        scores.extend(model.emissions(np.stack(ids[low : low + most_windows])))
    sums = [np.zeros((b - a, model.tags)) for _, a, b in group]
    weights = [np.zeros(b - a) for _, a, b in group]
    for (n, w), score in zip(place, scores):
        size = min(WINDOW, len(weights[n]) - w)
        sums[n][w : w + size] += score[:size] * _WEIGHT[:size, None]
        weights[n][w : w + size] += _WEIGHT[:size]
    return [model.decode(s / w[:, None]) for s, w in zip(sums, weights)]


def _runs(tags):
    start, kind = None, None
    for i, tag in enumerate([*tags, 0]):
        if start is not None and (tag == 0 or tag % 2 or (tag - 1) // 2 != kind):
            yield start, i, kind
            start = None
        if tag % 2:
            start, kind = i, (tag - 1) // 2


def all_spans(model: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and model spans) of each text."""
    base = [base_spans(t) for t in texts]
    more = model_spans(model, texts) if model else [[] for _ in texts]
    out = []
    for text, own, extra in zip(texts, base, more):
        covered = sorted((a, b) for a, b, _ in own)
        added = []
        for a, b, kind in extra:
            a, b = _trim(text, a, b)
            if a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
                continue
            if a < b and _fits(text[a:b], kind) and not any(x < b and a < y for x, y in covered):
                added.append((a, b, kind))
        out.append((own, sorted(own + added, key=lambda s: (s[0], s[2], s[1]))))
    return out


# -- training ----------------------------------------------------------------------------------------------------------


#: Values for made secrets: names that stand before them, what parts both, the alphabets.
_NAMES = ["token", "key", "secret", "api_key", "password", "access token", "auth", "Bearer"]
_PARTED = [' = "', ": ", "=", " ", ": '", ' := "']
_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]


def other_form(text: str, kind: int, rng) -> str:
    """The data of a base span in a form that its pattern does not know."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        return text.replace("@", pick(" @ ", " (at) ", "(at)", "[at]", " [at] ")).replace(".", pick(".", " (dot) ", "[dot]", " . "))
    if kind == 1:
        return text.replace(".", pick(" . ", "[.]", ",", ". ", "(.)"))
    digits = re.sub("[^0-9]", "", text)
    if kind == 2:
        mark, at = pick(".", "/", "_", " - ", "  "), 4
        return mark.join(digits[i : i + at] for i in range(0, len(digits), at))
    country, area, rest = digits[:-10], digits[-10:-7], digits[-7:]
    local = rest[:3] + pick("-", ".", " ", "/") + rest[3:]
    return pick("", f"00{country} ", f"{country} " if country else "") + pick(f"({area}) ", f"{area}-", f"{area}.", f"{area}/") + local


def secret(rng) -> tuple[str, int, int]:
    """(text, start, end) of a made secret with its name."""
    letters = _ALPHABETS[int(rng.integers(2))]
    value = ""
    while not value or not _fits(value, 4):
        value = "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(20, 49))))
    lead = _NAMES[int(rng.integers(len(_NAMES)))] + _PARTED[int(rng.integers(len(_PARTED)))]
    close = lead[-1] if lead[-1] in "\"'" else ""
    return lead + value + close, len(lead), len(lead) + len(value)


def labelled(text: str, rng, copies: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A text with its spans; copies with some in other forms and some made secrets between the words, one if it has none."""
    base = base_spans(text)
    # Secrets that stand in the text already must not be taught as ordinary words.
    keys = [(m.start(), m.end(), 4) for m in re.finditer("[A-Za-z0-9_+/=-]{20,}", text) if _fits(m[0], 4)]
    keys = [k for k in keys if not any(k[0] < b and a < k[1] for a, b, _ in base)]
    own = sorted(base + keys)
    return [(text, own), *(_varied(text, own, rng) for _ in range(copies if base else 1))]


def _varied(text: str, own, rng) -> tuple[str, list[tuple[int, int, int]]]:
    at, parts, spans, size = 0, [], [], 0

    def add(piece):
        nonlocal size
        parts.append(piece)
        size += len(piece)

    cuts = [m.start() for m in re.finditer(" ", text)]
    made = [(cuts[int(i)], cuts[int(i)], 4) for i in rng.integers(0, len(cuts), 1 + int(rng.integers(2)))] if cuts else []
    for a, b, kind in sorted(own + made):
        if a < at:
            continue
        add(text[at:a])
        if kind == 4 and a == b:
            piece, low, high = secret(rng)
            add(" ")
            spans.append((size + low, size + high, 4))
            add(piece)
        else:
            piece = other_form(text[a:b], kind, rng) if kind < 4 and rng.random() < 0.7 else text[a:b]
            spans.append((size, size + len(piece), kind))
            add(piece)
        at = b
    add(text[at:])
    return "".join(parts), spans


def train(
    docs: DataFrame, sample_docs: int = 1500, epochs: int = 2, hidden: int = 16, least_steps: int = 1200
) -> Tagger | None:
    """A model fitted on excerpts of at most sample_docs documents; None if no excerpt has a digit or an at sign.

    The sample comes from the 20 * sample_docs documents whose ids hash lowest: of those with a digit or an at sign, the
    ones with the least hash of their text.  An excerpt is 400 characters around the first such character.  Small samples
    are gone through until least_steps batches are seen.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]")).select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.expr("substring(text, greatest(1, regexp_instr(text, '[0-9@]') - 150), 400)").alias("part"),
    )
    picked = hash_sample(rows, ["doc_id"], 20 * sample_docs, docs.count())
    parts = [r.part for r in picked.orderBy("h", "part").limit(sample_docs).collect()]
    ids, tags, rng = [], [], np.random.default_rng(7)
    for text, spans in (x for part in dict.fromkeys(parts) for x in labelled(part, rng)):
        gold, codes = np.zeros(len(text), np.int64), char_ids(text)
        for a, b, kind in spans:
            if not gold[a:b].any():
                gold[a:b] = 2 * kind + 2
                gold[a] -= 1
        for a, b in stretches(text):
            for w in _windows(b - a):
                low, high = a + w, min(b, a + w + WINDOW)
                own = gold[low:high].copy()
                if own[0] and own[0] % 2 == 0:  # the border cuts a span; its rest is no whole one
                    continue
                pad = WINDOW - (high - low)
                ids.append(np.pad(codes[low:high], (0, pad), constant_values=PAD))
                tags.append(np.pad(own, (0, pad)))
    if not tags or not any(t.any() for t in tags):
        return None
    model = Tagger(KINDS, hidden)
    batch = 32
    rounds = max(epochs, -(-least_steps * batch // len(ids)))
    model.losses = model.fit(np.stack(ids), np.stack(tags), rounds, batch)
    return model


# -- on Spark ----------------------------------------------------------------------------------------------------------

FOUND = (
    "doc_id long, base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string>>"
)


def _find(shared):
    def cells(spans):
        return [{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans]

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                both = all_spans(shared.value, [x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([cells(b) for b, _ in both], kind), pa.array([cells(s) for _, s in both], kind)],
                    ["doc_id", "base", "spans"],
                )

    return run


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """(doc_id, base, spans) for every row of docs: spans in code points, by start, then kind.

    docs needs doc_id and text; other columns are left out.  Null and empty texts have no span; repeated rows come back
    repeated; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_find(shared), FOUND)


def redact_text(text: str, spans) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """docs, all rows and columns, with every span of text replaced by its kind's mark; n_chars, if there, follows.

    Null texts stay null, empty ones empty; repeated rows stay repeated; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def redact(cells: pd.Series) -> pd.Series:
        texts = [x or "" for x in cells]
        out = [redact_text(t, s) for t, (_, s) in zip(texts, all_spans(shared.value, texts))]
        return pd.Series(out, dtype=object)

    text = F.when(F.col("text").rlike(_TRIGGER.pattern), redact("text")).otherwise(F.col("text"))
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
