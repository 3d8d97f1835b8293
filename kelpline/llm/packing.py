"""Best-fit packing of documents into training sequences.

Token counts are whole numbers up to the capacity, so a corpus of any size has
a histogram of at most ``capacity`` entries. The packing is planned on that
histogram by bin completion and applied to the documents by rank within their
size; no step sees more than the histogram on the driver.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.common import materialise

#: The split of byte-level BPE: contractions, words, numbers, symbols, spaces.
BYTE_LEVEL_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's 2024: naïve  façade—\n\n\tтест 数 €9,99 …  end \r\n x"
#: White space that is left to tokenizers: tiktoken's matcher recurses over such runs and overflows its stack.
LONG_SPACE = re.compile(r"\s{4096}")

#: Rows of one size that one window group ranks.
RANK_GROUP = 50_000


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to token ids for the tokenizer file at ``path``.

    A byte-level BPE whose ids are its merge ranks is run by tiktoken, which
    gives the same ids several times faster (a test compares them over every
    code point); anything else, and any text that holds a special token or a
    very long run of white space, goes through tokenizers itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_padding()
    slow.no_truncation()

    def plainly(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec.get("added_tokens") or []]
    try:
        import tiktoken

        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
        fast = tiktoken.Encoding("fast", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        if fast.encode_ordinary(_PROBE) != plainly(_PROBE):
            return plainly
    except (KeyError, TypeError, ValueError, ImportError):
        return plainly

    def encode(text: str) -> list[int]:
        if any(s in text for s in specials) or LONG_SPACE.search(text):
            return plainly(text)
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids_crc32, turn[, token_ids].

    A null or empty text has the end id alone. A null doc_id stays null.
    ``turn`` counts the pieces of a task: it deals out what is alike in all else.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64())] + [("token_ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        encode, turn = encoder(tokenizer_path), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (doc_id, k, start, length, zlib.crc32(own.tobytes()), turn)
                    turn += 1
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long" + ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


# ---------------------------------------------------------------- the plan


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of bins, by what large items must waste (Martello and Toth).

    ``counts[s]`` items of size s.
    """
    sizes = np.arange(capacity + 1)
    n, v = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    half = capacity // 2
    k = np.arange(half + 1)
    over = n[-1] - n[capacity - k + 1]
    mid = n[capacity - k + 1] - n[half + 1]
    mid_v = v[capacity - k + 1] - v[half + 1]
    small_v = v[half + 1] - v[k]
    short = np.maximum(0, small_v - (mid * capacity - mid_v))
    return int(np.max(over + mid + -(-short // capacity)))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (items of a bin, number of such bins)."""
    bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(items: tuple[int, ...], room: int, times: int) -> None:
        if times:
            if room not in bins:
                bins[room] = []
                rooms.insert(bisect_right(rooms, room), room)
            bins[room].append([items, times])

    for s in np.nonzero(counts)[0][::-1]:
        s, left = int(s), int(counts[s])
        while left:
            at = bisect_right(rooms, s - 1)
            if at == len(rooms):
                each = capacity // s
                put((s,) * each, capacity - s * each, left // each)
                put((s,) * (left % each), capacity - s * (left % each), int(left % each > 0))
                break
            room = rooms[at]
            items, times = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            each = min(room // s, left)
            use = min(times, left // each)
            put(items, room, times - use)
            put(items + (s,) * each, room - s * each, use)
            left -= use * each
    return [(items, times) for same in bins.values() for items, times in same]


def fillings(avail: list[int], counts: np.ndarray, room: int, most: int = 6, visits: int = 3000, deep: int = 8) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first, fewest items on ties.

    ``avail`` ascends. A filling is dominated where an unused item could be
    added, or could replace some of its items and leave it at least as full.
    The search is bounded: ``visits`` steps, ``most`` fillings kept, the largest
    400 sizes for the first item and 24 for each later one; past ``deep`` items
    a filling is completed with the largest that fit.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    seen, best = 0, -1

    def finished(chosen: tuple[int, ...], left: int, at: int) -> tuple[tuple[int, ...], int]:
        """The filling with the largest items that still fit, from ``avail[at]`` down."""
        at = min(at, bisect_right(avail, left) - 1)
        while at >= 0 and left >= avail[0]:
            s = avail[at]
            k = min(left // s, int(counts[s]) - chosen.count(s))
            chosen, left = chosen + (s,) * k, left - s * k
            at = min(at, bisect_right(avail, left)) - 1
        return chosen, left

    def descend(chosen: tuple[int, ...], left: int, top: int) -> None:
        nonlocal seen, best
        at = bisect_right(avail, min(left, top)) - 1
        tried = 0
        while at >= 0 and seen < visits and tried < (24 if chosen else 400):
            s = avail[at]
            at -= 1
            if counts[s] <= chosen.count(s):
                continue
            seen, tried = seen + 1, tried + 1
            rest = left - s
            grown = (*chosen, s)
            if rest and avail[0] <= rest and len(grown) < deep:
                descend(grown, rest, s)
                continue
            if rest and avail[0] <= rest:
                grown, rest = finished(grown, rest, at + 1)
            if rest <= room - best + 8:
                found.append((rest, grown))
                best = max(best, room - rest)
            if best == room and len(found) >= most:
                return

    if not avail or avail[0] > room:
        return [()]
    descend((), room, room)
    if not found:  # the steps ran out before the first filling
        return [finished((), room, len(avail) - 1)[0]]
    found.sort(key=lambda x: (x[0], len(x[1])))
    kept = []
    for slack, own in found:
        if slack and any(avail[i] not in own for t in own for i in range(bisect_right(avail, t), bisect_right(avail, t + slack))):
            continue  # a larger item fits in the place of one of its items
        if len(own) == 2 and slack >= 0 and bisect_right(avail, sum(own) + slack) > bisect_right(avail, sum(own) - 1):
            continue  # one item does as well as two, and leaves the two for other bins
        if own not in kept:
            kept.append(own)
        if len(kept) == most:
            break
    return kept or [found[0][1]]


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 6000) -> list[tuple[tuple[int, ...], int]]:
    """Fewest bins found for a histogram: [(items of a bin, number of such bins)].

    Depth-first branch and bound: each node takes the largest item left, tries
    its undominated fillings and repeats the chosen bin while the items last.
    A branch ends where the waste so far, or the bound on the rest, reaches the
    incumbent, which starts as the best-fit packing and is replaced by better
    leaves. After ``nodes`` nodes the incumbent stands: it always holds every
    item.
    """
    counts = counts.astype(np.int64).copy()
    total = int((counts * np.arange(capacity + 1)).sum())
    if not total:
        return []
    incumbent = best_fit(counts, capacity)
    best, least = sum(t for _, t in incumbent), waste_bound(counts, capacity)
    path: list[tuple[tuple[int, ...], int]] = []
    # a frame: the fillings not yet tried, the largest item, the waste and the bins before it
    stack: list[tuple[list, int, int, int]] = []

    def open_node(waste: int, used: int) -> None:
        avail = np.nonzero(counts)[0]
        largest = int(avail[-1])
        counts[largest] -= 1
        own = [int(s) for s in avail if counts[s]]
        choices = fillings(own, counts, capacity - largest)
        counts[largest] += 1
        stack.append((choices[::-1], largest, waste, used))

    open_node(0, 0)
    visited = 1
    while stack and best > least and visited < nodes:
        choices, largest, waste, used = stack[-1]
        while len(path) >= len(stack):  # undo what was tried from this frame
            items, times = path.pop()
            for s in items:
                counts[s] += times
        if not choices:
            stack.pop()
            continue
        items = (largest, *choices.pop())
        need: dict[int, int] = {}
        for s in items:
            need[s] = need.get(s, 0) + 1
        times = min(int(counts[s]) // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= k * times
        path.append((items, times))
        waste, used = waste + (capacity - sum(items)) * times, used + times
        visited += 1
        if not counts.any():
            if used < best:
                best, incumbent = used, list(path)
            continue
        if waste > (best - 1) * capacity - total or used + waste_bound(counts, capacity) >= best:
            continue
        open_node(waste, used)
    return incumbent


def placement(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as lookup columns, sorted by (size, first rank)."""
    first: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in sorted(plan, key=lambda x: (-sum(x[0]), x)):
        offset = 0
        for s in sorted(set(items), reverse=True):
            k = items.count(s)
            rank = first.get(s, 0)
            rows.append((s, rank, k, sequence, offset))
            first[s] = rank + k * times
            offset += s * k
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank", "each", "sequence", "offset"), columns, strict=True))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as found.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and token_ids on request). Null and empty texts hold
    the end id alone; repeated rows are packed each for itself; an empty table
    gives an empty result; other columns are ignored.

    Scale: texts are tokenised once and the small piece rows are written to
    the shared folder. The driver gets the histogram of lengths (at most
    ``capacity`` rows) and returns a plan of at most ``capacity`` bin patterns,
    each of under 64 sizes. Ranks within a size come from windows over salted
    groups of about RANK_GROUP rows (rows alike in every column included), so a
    size that holds a third of all pieces is spread over many tasks.
    """
    cut_up = materialise(pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    histogram = {int(r[0]): int(r[1]) for r in cut_up.groupBy("length").count().collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        counts[s] = n
    plan = placement(bin_completion(counts, capacity))
    return _place(cut_up, counts, plan)


def _place(cut_up: DataFrame, counts: np.ndarray, plan: dict[str, np.ndarray]) -> DataFrame:
    salts = [int(max(1, -(-n // RANK_GROUP))) for n in counts]
    salted = cut_up.withColumn("salt", F.pmod(F.col("turn"), F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int") + 1)).cast("int"))
    shares = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "turn")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(shares, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first")
    span = np.int64(1) << 40
    starts = plan["size"] * span + plan["rank"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * span + rank, side="right") - 1
            nth = rank - plan["rank"][at]
            sequence = plan["sequence"][at] + nth // plan["each"][at]
            offset = plan["offset"][at] + nth % plan["each"][at] * length
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32", "token_ids") if c in cut_up.columns]
    ddl = ", ".join(f"{c} {t}" for c, t in cut_up.dtypes if c in names)
    return ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long")
