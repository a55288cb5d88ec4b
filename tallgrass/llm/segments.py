"""Tokenising many texts by remembering their space-delimited segments.

A pre-tokeniser of the byte-level family never lets a token cross a space that
is followed by a non-space character, so a text is the concatenation of
segments that may be encoded alone.  Segments repeat far more often than whole
texts: Arrow finds the distinct ones of a batch, a bounded memo answers those
seen before, and only the rest reaches the encoder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries, and bytes of ids and segments, after which a worker's memo starts anew: about 150 MB with the dictionary.
MEMO_ENTRIES, MEMO_BYTES = 500_000, 64 << 20
#: Characters from which a segment isn't remembered, as texts without spaces are single segments.
LONG = 64
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 4 << 20

#: Segments that reach the library as one text.
RUN = 64

_BREAK = re.compile(r" (?=\S)")
#: A space before white space or the end; such texts are cut by the pattern above.
_ODD_SPACE = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]| $"

Ragged = tuple[np.ndarray, np.ndarray]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenates flat[starts[i] : starts[i] + lens[i]] over all i."""
    if not len(lens):
        return flat[:0]
    ends = np.cumsum(lens)
    kind = np.int32 if max(len(flat), int(ends[-1])) < 1 << 31 else np.int64
    step = np.repeat((starts - (ends - lens)).astype(kind), lens)
    step += np.arange(len(step), dtype=kind)
    return flat[step]


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cuts a string array into runs of rows of about `most` bytes; a longer text stays whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


class SegmentEncoder:
    """Encodes texts by segments.

    encode(segments): ids of each segment, as one flat array and their lengths.
    whole: texts that contain this string bypass the segments (special tokens
    are looked for before pre-tokenising, so they may change the cut).
    cut: where texts with a space before white space or the end are cut; None:
    nowhere, for encoders that may merge spaces.
    Null and empty texts have no ids.  What is remembered between batches is
    bounded by entries and bytes; long segments are never remembered.
    """

    def __init__(self, encode: Callable[[list[str]], Ragged], whole: str | None = None, entries: int = MEMO_ENTRIES, most: int = MEMO_BYTES, cut: re.Pattern | None = _BREAK):
        self.encode, self.whole, self.entries, self.most, self.cut = encode, whole, entries, most, cut
        self._reset()

    def _reset(self) -> None:
        #: Slots of segments that follow a space, and of first ones; no mark within a text could tell them apart.
        self.slot: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.held, self.key_bytes = 0, 0
        self.starts, self.lens = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.flat, self.used = np.empty(1 << 18, np.uint32), 0

    @property
    def memo_bytes(self) -> int:
        """Bytes of remembered segments and of the arrays that hold ids."""
        return self.key_bytes + self.flat.nbytes

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.empty(max(n, len(a) + min(len(a), 1 << 22)), a.dtype)
        b[: len(a)] = a
        return b

    def _taken(self, segments: list[str], first: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments[code] in order, and the number of each."""
        if self.held > self.entries or self.memo_bytes > self.most:
            self._reset()
        held, first = self.held, np.asarray(first, bool)
        slots = np.empty(len(segments), np.int64)
        for f in (False, True):
            at = np.flatnonzero(first == f)
            some = segments if len(at) == len(segments) else [segments[i] for i in at]
            slots[at] = np.fromiter(map(self.slot[f].get, some, repeat(-1)), np.int64, len(at))
        missing = np.flatnonzero(slots < 0)
        kept_ids = self.used
        if len(missing):
            size = np.fromiter(map(len, [segments[i] for i in missing]), np.int64, len(missing))
            # Short ones that follow a space, short first ones, long ones.
            missing = missing[np.argsort(np.where(size >= LONG, 2, first[missing]), kind="stable")]
            n, short, plain = len(missing), int((size < LONG).sum()), int((~first[missing[: int((size < LONG).sum())]]).sum())
            new = [segments[i] for i in missing]
            ids, lens = self.encode([s if f else " " + s for s, f in zip(new, first[missing].tolist())])
            self.starts, self.lens = self._room(self.starts, held + n), self._room(self.lens, held + n)
            self.flat = self._room(self.flat, self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.lens[held : held + n] = lens
            self.starts[held : held + n] = self.used + np.cumsum(lens) - lens
            kept_ids = self.used + int(lens[:short].sum())
            slots[missing] = np.arange(held, held + n)
            self.slot[False].update(zip(new[:plain], range(held, held + plain)))
            self.slot[True].update(zip(new[plain:short], range(held + plain, held + short)))
            self.key_bytes += int(size[size < LONG].sum())
            self.held += short
        slots = slots[code]
        lens = self.lens[slots].astype(np.int64)
        ids = ragged_take(self.flat, self.starts[slots], lens)
        self.used = kept_ids  # long segments give their places back
        return ids, lens

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Segments of all texts in order, and their number in each; a space that is left out stands before all but a text's first."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        if self.whole:
            odd = pc.or_(odd, pc.match_substring(texts, self.whole))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts, " ")
        if not len(odd):
            return lists.flatten(), np.diff(lists.offsets.to_numpy())
        parts = lists.to_pylist()
        for i in odd:
            text = texts[int(i)].as_py()
            parts[i] = [text] if self.cut is None or self.whole and self.whole in text else self.cut.split(text)
        return pa.array([s for p in parts for s in p], pa.string()), np.fromiter(map(len, parts), np.int64, len(parts))

    def batch(self, texts: pa.Array) -> Ragged:
        """Ids of all texts in order and their number for each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        segments, per_text = self.segments(texts)
        at = np.concatenate(([0], np.cumsum(per_text)))
        coded = segments.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy().astype(np.int64) * 2
        code[at[:-1]] += 1  # a text's first segment
        used = np.flatnonzero(np.bincount(code, minlength=2 * len(words)))
        place = np.zeros(2 * len(words), np.int64)
        place[used] = np.arange(len(used))
        ids, lens = self._taken([words[i] for i in (used >> 1).tolist()], used & 1, place[code])
        ends = np.concatenate(([0], np.cumsum(lens)))
        return ids, np.diff(ends[at])


def library_encoder(path: str, entries: int = MEMO_ENTRIES, most: int = MEMO_BYTES, plain: bool = False) -> SegmentEncoder:
    """A SegmentEncoder over the tokenizers library for a byte-level .json file, with its default handling of special strings.

    plain: strings of special tokens are ordinary text.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    special = [] if plain else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if len(special) > 1:
        raise ValueError("one special token at most")
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        opens[i] = token.startswith("Ġ")  # the byte-level name of a space

    def alone(segments: list[str]) -> Ragged:
        found = [e.ids for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens

    def encode(segments: list[str]) -> Ragged:
        """Joins segments that open with a space, as each then opens with a token that does; runs where other tokens do too are encoded one by one."""
        spaced = np.flatnonzero(np.fromiter([s[:1] == " " for s in segments], bool, len(segments)))
        runs = [spaced[i : i + RUN] for i in range(0, len(spaced), RUN)]
        joined = ["".join([segments[i] for i in run]) for run in runs]
        flats, placed, lens = [], [], np.zeros(len(segments), np.int64)
        single = [np.setdiff1d(np.arange(len(segments)), spaced, assume_unique=True)]
        for run, text, found in zip(runs, joined, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            at = np.flatnonzero(opens[ids])
            if len(at) != len(run) or any(s in text for s in special):
                single.append(run)
                continue
            lens[run] = np.diff(np.append(at, len(ids)))
            flats.append(ids)
            placed.append(run)
        rest = np.concatenate(single)
        if len(rest):
            ids, lens[rest] = alone([segments[i] for i in rest])
            flats.append(ids)
            placed.append(rest)
        placed = np.concatenate(placed)
        starts = np.empty(len(segments), np.int64)
        starts[placed] = np.cumsum(lens[placed]) - lens[placed]
        return ragged_take(np.concatenate(flats), starts, lens), lens

    return SegmentEncoder(encode, special[0] if special else None, entries, most)


def piece_encoder(path: str) -> SegmentEncoder:
    """A SegmentEncoder over sentencepiece for texts that have one space put before them, which the model itself would put there.

    Segments may be encoded alone because no piece of the model has a space
    behind another character; texts with spaces before white space or at the
    end are encoded whole.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    space = "\u2581"
    if any(space in model.id_to_piece(i).lstrip(space) for i in range(model.get_piece_size())):
        raise ValueError("a piece crosses a space")

    def encode(segments: list[str]) -> Ragged:
        found = model.encode([s[1:] for s in segments], num_threads=1)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens

    return SegmentEncoder(encode, cut=None)


_ENCODERS: dict[tuple[str, bool], SegmentEncoder] = {}


def shared_encoder(path: str, plain: bool = False) -> SegmentEncoder:
    """The encoder of this Python worker for a file; its memo lives as long as the worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = path, plain
    if key not in _ENCODERS:
        _ENCODERS[key] = piece_encoder(path) if path.endswith(".model") else library_encoder(path, plain=plain)
    return _ENCODERS[key]
