"""Packing of tokenised documents into windows by minimum bin slack.

Documents are cut into full windows and one remainder. For the remainders, a window starts from the largest length
that is left, and a subset-sum table over the multiset of remaining lengths, held as one big integer whose bit ``s``
says that sum ``s`` can be reached, finds the filling closest to the capacity; walking the tables back gives how many
pieces of each length it takes. A filling is used as often as the counts allow, so plans stay small. Windows that a plan
leaves a little short are kept: the emptiest give their pieces, which fill the slack of the others, and what remains of
them is cut into runs that are powers of two. So no sequence needs padding, and nearly all pieces lie whole where they
were planned.

Each task packs its own rows, some millions of ids at a time: no shuffle, no driver, no global state.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"  # the same vocabulary, ids and splitting as byte_bpe_50k.json, as ranks
SPECIAL = {"<|endoftext|>": 50256}  # fixed: the vocabulary's special token
CHUNK_IDS = 4_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None):
    """A function from a text to its ids. The vocabulary's one special string is its special id wherever a text has it, as
    in the tokenizer file of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path or default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    special = tuple(SPECIAL)
    return lambda text: encoding.encode(text, allowed_special="all") if any(s in text for s in special) else encoding.encode_ordinary(text)


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of at most ``counts[l]`` pieces of each length l whose sum comes closest to the capacity."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Windows as (lengths, how many such windows); the counts are used up. The last may be filled only partly."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items() if v - (k == seed) > 0 and k <= window - seed}
        chosen = Counter(best_filling(rest, window - seed) if rest else {})
        chosen[seed] += 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append(([k for k in sorted(chosen, reverse=True) for _ in range(chosen[k])], times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _pack_chunk(docs: list[tuple], window: int, first_sequence: int) -> tuple[list[tuple], int]:
    """(row, start, ids, sequence, offset) of all pieces of some documents, and the next free sequence number."""
    out, sequence = [], first_sequence
    by_length: dict[int, list] = {}
    for row, ids in docs:
        full = len(ids) // window * window
        for start in range(0, full, window):
            out.append((row, start, ids[start : start + window], sequence, 0))
            sequence += 1
        if len(ids) > full:
            by_length.setdefault(len(ids) - full, []).append((row, full, ids[full:]))
    windows = []  # (ids, pieces) of planned windows that are neither full nor a power of two long
    for lengths, times in plan({k: len(v) for k, v in by_length.items()}, window):
        full = sum(lengths)
        for _ in range(times):
            pieces = [by_length[k].pop() for k in lengths]
            if full & (full - 1):
                windows.append((full, pieces))
                continue
            offset = 0
            for row, start, ids in pieces:
                out.append((row, start, ids, sequence, offset))
                offset += len(ids)
            sequence += 1
    # the emptiest windows give their pieces: as many as fill the slack of all others, which stay as they were planned
    windows.sort(key=lambda w: w[0])
    slack, given, partly, first = sum(window - w[0] for w in windows), 0, [], 0
    while first < len(windows) and given < slack:
        full, pieces = windows[first]
        slack, given, first = slack - (window - full), given + full, first + 1
        partly += pieces
    for full, pieces in windows[first:]:
        offset = 0
        while offset < full:
            row, start, ids = pieces.pop()
            out.append((row, start, ids, sequence, offset))
            offset += len(ids)
        while offset < window:
            row, start, ids = partly.pop()
            n = min(window - offset, len(ids))
            out.append((row, start, ids[:n], sequence, offset))
            offset += n
            if n < len(ids):
                partly.append((row, start + n, ids[n:]))
        sequence += 1
    # what is left of them is cut into full windows and then falling powers of two
    room, offset, left = 0, 0, sum(len(p[2]) for p in partly)
    for row, start, ids in partly:
        while len(ids):
            if not room:
                room = min(window, 1 << (left.bit_length() - 1))
                left -= room
                sequence, offset = sequence + (offset > 0), 0
            n = min(room, len(ids))
            out.append((row, start, ids[:n], sequence, offset))
            start, ids, room, offset = start + n, ids[n:], room - n, offset + n
    return out, sequence + (offset > 0)


def _packer(window: int, path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, sequence = encoder(path), TaskContext.get().partitionId() << 36
        held, doc_ids, size = [], [], 0

        def flush():
            nonlocal sequence, held, doc_ids, size
            pieces, sequence = _pack_chunk(held, window, sequence)
            out = pd.DataFrame({
                "doc_id": pd.array([doc_ids[p[0]] for p in pieces], "Int64"), "start": [p[1] for p in pieces], "length": [len(p[2]) for p in pieces],
                "ids": [p[2].tobytes() for p in pieces], "doc_tokens": [len(held[p[0]][1]) for p in pieces], "sequence_id": [p[3] for p in pieces], "offset": [p[4] for p in pieces],
            })
            held, doc_ids, size = [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                doc_ids.append(doc_id)
                held.append((len(held), np.array([*encode(text or ""), 0], "<u4")))
                size += len(held[-1][1])
                if size >= CHUNK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) placed in sequences: doc_id, start, length, ids (little-endian
    unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    A document's ids are those of its text and a closing id 0, so an empty or null text is the single id 0. Sequences are
    full or a power of two long; none needs padding. Repeated rows are packed once each, null ids stay null, an empty
    table gives no rows, and other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInPandas(_packer(window, path), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
