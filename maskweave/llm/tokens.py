"""Token ids of whole texts by a public byte-level BPE vocabulary.

Ids equal `tokenizers`' `encode(text, add_special_tokens=False)`.  A cut before the last white-space
character ahead of a word never crosses a pre-token, so texts are cut there, distinct pieces of a batch
are tokenised once (joined, in one call) and their ids gathered back.  Texts holding other Unicode white
space or the vocabulary's special string go through `tokenizers` itself.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from maskweave.llm.common import NON_SPACE, binary_array, ranges

#: White space outside ASCII that the pre-tokeniser's `\s` matches, and the vocabulary's special string.
SLOW = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|endoftext\|>"


class Vocabulary:
    """`json` is the `tokenizers` file; the rank file of the same vocabulary lies beside it."""

    def __init__(self, json: str) -> None:
        import public_tokenizers
        import tiktoken

        ranks = Path(json).with_suffix(".tiktoken")
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
        self.json = json
        self.bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, np.int64)
        for piece, rank in table.items():
            self.width[rank] = len(piece)
        self.whole = None

    def slow(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json)
        return self.whole.encode(text, add_special_tokens=False).ids

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece starts with the end appended, and the first piece of each row with the total appended."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        if n:
            word = NON_SPACE[data]
            start[: n - 1] = ~word[:-1] & word[1:]
            start[off[off > 0] - 1] = False  # a row's last byte has nothing after it
        start[off] = True
        start[n] = False
        at = np.flatnonzero(start)
        first = np.searchsorted(at, off)
        return np.append(at, n), first

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row (uint32) and their offsets."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        at, first = self.pieces(data, off)
        coded = binary_array(data, at).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())
        slow = pc.match_substring_regex(distinct, SLOW).to_numpy(zero_copy_only=False)
        ids, idoff = self._distinct(distinct, slow)
        odd = np.unique(np.searchsorted(first, np.flatnonzero(slow[which]), "right") - 1) if slow.any() else []
        many = np.diff(idoff)[which]
        flat = ids[ranges(idoff[which], many)]
        tokoff = np.concatenate([[0], np.cumsum(many)])[first]
        if len(odd):
            parts = np.split(flat, tokoff[1:-1])
            for k in odd:
                parts[k] = np.array(self.slow(data[off[k] : off[k + 1]].tobytes().decode()), np.uint32)
            tokoff = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            flat = np.concatenate(parts)
        return flat, tokoff

    def _distinct(self, pieces: pa.Array, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: those that begin with white space before a word are joined and encoded at once."""
        _, o, d = pieces.buffers()
        off = np.frombuffer(o, np.int64, len(pieces) + 1, pieces.offset * 8)
        raw = np.frombuffer(d, np.uint8)
        lead = raw[off[:-1]]
        after = raw[np.minimum(off[:-1] + 1, len(raw) - 1)]
        joins = ~NON_SPACE[lead] & NON_SPACE[after] & (np.diff(off) > 1) & ~slow
        order = np.concatenate([np.flatnonzero(~joins), np.flatnonzero(joins)])
        alone = int((~joins).sum())
        made = [self.bpe.encode_ordinary(raw[off[k] : off[k + 1]].tobytes().decode()) for k in order[:alone].tolist()]
        tail = order[alone:]
        length = np.diff(off)[tail]
        joined = np.array(self.bpe.encode_ordinary(raw[ranges(off[tail], length)].tobytes().decode()) if len(tail) else [], np.uint32)
        ends = np.cumsum(self.width[joined])
        stops = np.searchsorted(ends, np.cumsum(length), "left") + 1 if len(tail) else np.zeros(0, np.int64)
        counts = np.concatenate([[len(x) for x in made], np.diff(np.concatenate([[0], stops]))]).astype(np.int64)
        ids = np.concatenate([np.array([x for y in made for x in y], np.uint32), joined])
        begin = np.concatenate([[0], np.cumsum(counts)])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        out = np.concatenate([[0], np.cumsum(counts[back])])
        return ids[ranges(begin[back], counts[back])], out
