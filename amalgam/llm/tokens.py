"""Token ids of whole texts by a public tokenizer file, computed once per distinct chunk between ASCII white space.

A tokenizer that drops white space, and neither whose normalizer nor whose splits reach across it, gives a
text the ids of its chunks in order. Only those that are known to do so are used by chunk; with any other
file, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: The normalizer and the splits that allow it to encode chunk by chunk.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def chunks_are_apart(tokenizer) -> bool:
    """Whether a tokenizer drops white space and looks at what stands between on its own."""
    made = json.loads(tokenizer.to_str())
    normal, split = (made.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps = normal.get("normalizers", [])
    first = (split.get("pretokenizers") or [{}])[0]
    blank = any(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps)
    cut = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLITS} and first.get("behavior") == "Removed" and first.get("invert") is True
    return [x["type"] for x in steps] == NORMALIZER and blank and cut and made["model"].get("end_of_word_suffix") == "</w>"


#: Pieces that are encoded as one text.
JOINED = 500
_encoders: dict[str, ChunkEncoder] = {}


def encoder(name: str) -> ChunkEncoder:
    """This process's encoder: what one task has learned serves the next."""
    if name not in _encoders:
        _encoders[name] = ChunkEncoder(name)
    return _encoders[name]


class ChunkEncoder:
    """Encodes texts; keeps the ids of up to ``most`` distinct chunks."""

    def __init__(self, name: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_path(name)), most
        self.by_chunk = chunks_are_apart(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

    def _plain_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are words to the tokenizer: many go into one text, and tokens that end words show where each stops."""
        texts = [" ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids, _ = self._ids_of(texts)
        stop = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stop) != len(pieces):
            return self._ids_of(pieces)
        return ids, np.diff(stop, prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), f"^({LETTER}+|{SIGN}+)$").to_numpy(zero_copy_only=False)
        for some, ids_of in ((plain, self._plain_ids), (~plain, self._ids_of)):
            own = [pieces[i] for i in np.flatnonzero(some).tolist()]
            if not own:
                continue
            flat, length = ids_of(own)
            at = len(self.place)
            self.place.update(zip(own, range(at, at + len(own)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, flat])

    def _lists(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in ``self.ids``, and how many there are."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) > self.most:
            self._clear()
        if new := [w for w in distinct if w not in self.place]:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        return self.begin[place], self.length[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and how many each has."""
        if not self.by_chunk:
            return self._ids_of([t or "" for t in texts.to_pylist()])
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        chunks = words.flatten().dictionary_encode()
        pieces = pc.ascii_split_whitespace(spaced(chunks.dictionary))
        begin, length = self._lists(pieces.flatten())
        of_chunk, n = gather(self.ids, begin, length, pieces.offsets.to_numpy() - pieces.offsets[0].as_py())
        code = chunks.indices.to_numpy()
        start = np.cumsum(n) - n
        return gather(of_chunk, start[code], n[code], words.offsets.to_numpy() - words.offsets[0].as_py())


def gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin:begin+length] of all runs one after another, and how many each group of runs has."""
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(stop) else 0
    at = np.repeat(begin - (stop - length), length) + np.arange(total)
    return values[at], np.diff(np.concatenate([[0], stop])[groups])


#: Letters that normalization and lower case leave single letters, and ASCII signs without the apostrophe.
LETTER, SIGN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]", r"[!-&(-/:-@\[-`{-~]"


def spaced(chunks: pa.Array) -> pa.Array:
    """The chunks with A-Z in lower case and a space between plain letters and signs, where the tokenizer cuts anyway.

    Left as they are: chunks that may hold a special token, a contraction, or a letter whose lower case depends on what follows.
    """
    keep = pc.match_substring_regex(chunks, "<[|]|'|\u03a3")
    cut = pc.replace_substring_regex(pc.ascii_lower(chunks), f"({LETTER})({SIGN})", r"\1 \2")
    cut = pc.replace_substring_regex(cut, f"({SIGN})({LETTER})", r"\1 \2")
    return pc.if_else(keep, chunks, cut)
