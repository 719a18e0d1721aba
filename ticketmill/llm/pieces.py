"""Encode and decode texts with a SentencePiece BPE model, by vectorised merge rounds.

A text is cut into words that no piece reaches across. Each distinct word of a run of texts is
encoded once: all words lie in one flat array of symbols, and a round finds every word's best pair
by a segmented minimum, merges its occurrences from the left and closes the gaps, until no pair is
left anywhere.

A round merges all occurrences of a word's best pair together, from the left up to the first one whose
merged piece forms a pair with a neighbour that is at least as good: the library would take that pair
next, and so does the next round. Words that are not ready after ``ROUNDS`` rounds, very long ones of
many different pieces, go on from where they are with a queue of pairs of their own, so a word's time
grows with its length times its logarithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import list_column, prepare, text_chunks
from .memory import Memory, gather, ramp

SPACE = "▁"
NEVER = np.int32(2**31 - 1)
#: Rounds over all words of a run; words that need more are finished one by one.
ROUNDS = 96


def load(path: str) -> dict:
    """The model's vocabulary as plain arrays; models that would need other steps are refused."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = [p.type for p in model.pieces]
    plain = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not set(kinds) <= {1, 2, 3, 6} or 6 not in kinds:
        raise ValueError("a BPE model with byte pieces and without user-defined or unused pieces is needed")
    if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix:
        raise ValueError("the model normalises texts in a way that is not covered")
    names = [p.piece for p in model.pieces]
    ids = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == 1}
    order = sorted({-model.pieces[i].score for i in ids.values()})
    place = {s: r for r, s in enumerate(order)}
    rank = np.full(len(names) + 1, NEVER, np.int32)
    for i in ids.values():
        rank[i] = place[-model.pieces[i].score]
    chars = np.full(0x110000, -1, np.int32)
    pairs, bigrams = {}, set()
    may_rise = np.zeros(len(names) + 1, bool)
    for name, i in ids.items():
        if len(name) == 1:
            chars[ord(name)] = i
        bigrams.update((ord(a) << 21) | ord(b) for a, b in zip(name, name[1:]))
        for k in range(1, len(name)):
            a, b = ids.get(name[:k]), ids.get(name[k:])
            if a is not None and b is not None:
                pairs[(a << 32) | b] = i
                for part in (a, b):
                    may_rise[part] |= rank[i] <= rank[part]
    keys = np.array(sorted(pairs), np.int64)
    surfaces, byte_ids = [], np.zeros(256, np.int32)
    for i, (name, kind) in enumerate(zip(names, kinds)):
        if kind == 6:
            byte_ids[int(name[3:5], 16)] = i
            surfaces.append(bytes([int(name[3:5], 16)]))
        else:
            known = {1: name.replace(SPACE, " "), 2: " ⁇ ", 3: ""}[kind]
            surfaces.append(known.encode())
    sizes = np.fromiter(map(len, surfaces), np.int64, len(surfaces))
    return {
        "rank": rank, "chars": chars, "bigrams": np.array(sorted(bigrams), np.int64),
        "keys": keys, "merged": np.array([pairs[k] for k in keys.tolist()], np.int32),
        "may_rise": may_rise, "byte_ids": byte_ids,
        "blob": np.frombuffer(b"".join(surfaces), np.uint8), "sizes": sizes,
        "starts": np.cumsum(sizes) - sizes,
        "spaced": np.array([k == 1 and n.startswith(SPACE) for n, k in zip(names, kinds)]),
        "is_byte": np.array([k == 6 for k in kinds]),
        "no_newline": not any("\n" in n for n in ids),
    }


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _pair_of(model: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The piece that each pair of symbols merges into, or -1."""
    at, known = _found(model["keys"], (left.astype(np.int64) << 32) | right)
    return np.where(known & (left >= 0) & (right >= 0), model["merged"][at], np.int32(-1))


def _before_rise(model: dict, symbols, pair, first, hits: np.ndarray) -> np.ndarray:
    """Which of the chosen occurrences a round may merge: in each word those up to the first whose piece
    at once forms a pair of the same or a better rank, with the piece before or the symbol after it."""
    rises = np.zeros(len(hits), bool)
    able = np.flatnonzero(model["may_rise"][pair[hits]])
    if not len(able):
        return ~rises
    at = hits[able]
    piece = pair[at]
    left = symbols[np.maximum(at - 1, 0)]
    follows = np.zeros(len(hits), bool)
    follows[1:] = np.diff(hits) == 2
    # The occurrence before lies next to this one and is a piece by then.
    left = np.where(follows[able], pair[np.maximum(at - 2, 0)], left)
    left[first[at]] = -1
    after = np.minimum(at + 2, len(symbols) - 1)
    right = np.where((at + 2 < len(symbols)) & ~first[after], symbols[after], np.int32(-1))
    rank = model["rank"]
    best = np.minimum(rank[_pair_of(model, left, piece)], rank[_pair_of(model, piece, right)])
    rises[able] = best <= rank[piece]
    word = np.cumsum(first)[hits]
    earlier = np.cumsum(rises) - rises
    lead = np.ones(len(hits), bool)
    lead[1:] = np.diff(word) != 0
    return earlier == earlier[np.maximum.accumulate(np.where(lead, np.arange(len(hits)), 0))]


def _finish(model: dict, symbols: list[int], pair: np.ndarray) -> tuple[list[int], list[int]]:
    """(ids, places) of one word, merged pair by pair: the best rank first, ties from the left."""
    if "lookup" not in model:
        model["lookup"] = dict(zip(model["keys"].tolist(), model["merged"].tolist()))
    lookup, rank = model["lookup"], model["rank"]
    n = len(symbols)
    known = np.flatnonzero(pair >= 0)
    queue = np.sort((rank[pair[known]].astype(np.int64) << 32) | known).tolist()  # sorted is a heap
    pair = pair.tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = rank.tolist() if len(queue) > 1000 else rank

    def renew(at: int) -> None:
        right = after[at]
        made = -1
        if right < n and symbols[at] >= 0 and symbols[right] >= 0:
            made = lookup.get((symbols[at] << 32) | symbols[right], -1)
        pair[at] = made
        if made >= 0:
            heappush(queue, (int(rank[made]) << 32) | at)

    while queue:
        entry = heappop(queue)
        at = entry & 0xFFFFFFFF
        if pair[at] < 0 or rank[pair[at]] != entry >> 32:
            continue  # the pair is gone
        symbols[at] = pair[at]
        gone = after[at]
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        pair[gone] = -1
        renew(at)
        if before[at] >= 0:
            renew(before[at])
    places, at = [], 0
    while at < n:
        places.append(at)
        at = after[at]
    return [symbols[p] for p in places], places


def _merge_all(model: dict, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places) after all merges; ``first`` marks where words begin, places are old indices."""
    rank = model["rank"]
    done = np.full(len(symbols), np.int32(-2))
    place = np.arange(len(symbols))
    pair = np.full(len(symbols), np.int32(-1))
    inner = np.flatnonzero(~first[1:])
    pair[inner] = _pair_of(model, symbols[inner], symbols[inner + 1])
    for _ in range(ROUNDS):
        starts = np.flatnonzero(first)
        lengths = np.diff(starts, append=len(symbols))
        cost = rank[pair]
        best = np.repeat(np.minimum.reduceat(cost, starts), lengths)
        live = best != NEVER
        # Words without a pair are ready and leave the arrays.
        done[place[~live]] = symbols[~live]
        symbols, place, pair, first, cost, best = (
            x[live] for x in (symbols, place, pair, first, cost, best)
        )
        if not len(symbols):
            break
        hits = np.flatnonzero(cost == best)
        # In a run of overlapping occurrences every second one is merged, from the left.
        fresh = np.ones(len(hits), bool)
        fresh[1:] = np.diff(hits) != 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        hits = hits[_before_rise(model, symbols, pair, first, hits)]
        symbols[hits] = pair[hits]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[hits] = True
        changed[np.maximum(hits - 1, 0)] = True
        # The symbol before may itself have been swallowed by the one before it.
        changed[np.maximum(hits - 2, 0)] |= ~keep[np.maximum(hits - 1, 0)]
        symbols, place, pair, first, changed = (
            x[keep] for x in (symbols, place, pair, first, changed)
        )
        ends = np.append(first[1:], True)
        pair[ends] = -1
        anew = np.flatnonzero(changed & ~ends)
        pair[anew] = _pair_of(model, symbols[anew], symbols[anew + 1])
    starts = np.flatnonzero(first).tolist()
    for a, b in zip(starts, [*starts[1:], len(symbols)]):
        ids, at = _finish(model, symbols[a:b].tolist(), pair[a:b])
        done[place[a:b][at]] = ids
    places = np.flatnonzero(done != -2)
    return done[places], places


def encode_words(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all words, laid end to end."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    flat[flat == 0x20] = ord(SPACE)
    first = np.zeros(len(flat), bool)
    first[(ends - sizes)[sizes > 0]] = True
    first[1:] |= ~_found(model["bigrams"], (flat[:-1] << 21) | flat[1:])[1]
    ids, places = _merge_all(model, model["chars"][flat], first)
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        # Characters outside the vocabulary become their UTF-8 bytes.
        coded = [chr(c).encode("utf-8", "replace") for c in flat[places[unknown]]]
        counts = np.ones(len(ids), np.int64)
        counts[unknown] = [len(c) for c in coded]
        at = np.repeat(np.arange(len(ids)), counts)
        into = (np.cumsum(counts) - counts)[unknown]
        into = np.repeat(into, counts[unknown]) + ramp(counts[unknown])
        ids, places = ids[at], places[at]
        ids[into] = model["byte_ids"][np.frombuffer(b"".join(coded), np.uint8)]
    return ids, np.concatenate([[0], np.searchsorted(places, ends)])


def _slow_decode(model: dict, ids: np.ndarray) -> str:
    """Byte pieces that are not UTF-8: every byte that fits nowhere becomes U+FFFD."""
    out, run = [], b""

    def flush() -> None:
        nonlocal run
        while run:
            for n in range(1, min(4, len(run)) + 1):
                try:
                    out.append(run[:n].decode())
                    run = run[n:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                run = run[1:]

    for k, i in enumerate(ids.tolist()):
        surface = model["blob"][model["starts"][i] : model["starts"][i] + model["sizes"][i]].tobytes()
        if model["is_byte"][i]:
            run += surface
        else:
            flush()
            out.append(surface[1:].decode() if k == 0 and model["spaced"][i] else surface.decode())
    flush()
    return "".join(out)


def decode_ids(model: dict, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of runs of ids; the blank that stands before every text goes."""
    starts, sizes = model["starts"][ids], model["sizes"][ids]
    heads = offsets[:-1][np.diff(offsets) > 0]
    heads = heads[model["spaced"][ids[heads]]]
    starts[heads] += 1
    sizes[heads] -= 1
    raw = gather(model["blob"], starts, sizes).tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    out = []
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        try:
            out.append(raw[a:b].decode())
        except UnicodeDecodeError:
            out.append(_slow_decode(model, ids[offsets[k] : offsets[k + 1]]))
    return out


def cut(model: dict):
    """The function that cuts a text into words no piece reaches across."""
    find = re.compile("[ ▁]*[^ ▁\n]+|\n|[ ▁]+" if model["no_newline"] else "[ ▁]*[^ ▁]+|[ ▁]+").findall
    return lambda text: find(" " + text) if text else []


def encode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, ids array<int>) of every row: what the model's library returns, without begin and end.

    With ``decoded`` there is a third column ``text`` with what ``decode`` makes of the ids, in the
    same pass. A null text counts as an empty one and has no ids. Repeated rows give repeated rows;
    other columns are not looked at.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        # A worker's later tasks go on with the words of its earlier ones.
        if "memory" not in model:
            model["memory"] = Memory(lambda fresh: encode_words(model, fresh))
        memory = model["memory"]
        words = cut(model)
        for rows, data, offsets in text_chunks(batches):
            raw = data.tobytes()
            ids, at = memory.encode(
                [
                    words(raw[a:b].decode("utf-8", "replace"))
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                ]
            )
            out = {"id": rows.column("id").cast(pa.int64()), "ids": list_column(ids, at, pa.int32())}
            if decoded:
                out["text"] = pa.array(decode_ids(model, ids, at), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "id bigint, ids array<int>" + ", text string" * decoded
    return docs.selectExpr(f"`{id_column}` AS id", f"`{text}` AS text").mapInArrow(
        run, schema
    ).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, text): the text that the model's library makes of the ids; null ids give ''."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            texts = decode_ids(shared.value, ids, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), column, pa.array(texts, pa.string())],
                ["id", "ids", "text"],
            )

    return encoded.selectExpr(f"`{id_column}` AS id", "ids").mapInArrow(
        run, "id bigint, ids array<int>, text string"
    ).withColumnRenamed("id", id_column)
