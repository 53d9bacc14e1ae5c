"""Exact byte-level BPE token counts of every prefix by dynamic programming.

For a piece of pre-tokenised text the encoding of every prefix ends in exactly one
token: the one that can follow the encoding of what precedes it without any merge
across the border having come first.  So the DP needs, per prefix, one compatible
last token and one count, and no merging.  Counts of a text are sums over its pieces;
a piece's prefix counts are kept per worker in a bounded cache.

``counts`` gives one number a document; ``prefix_counts`` stores the count at every
code point, from which ``tokens_at`` and ``longest_prefix`` answer truncation and
budget questions with built-in array functions and without encoding again.

Defined cases: null and empty texts have 0 tokens and no prefixes; a text is processed
whole, whatever its length; repeated rows are counted each; special strings inside a
text are one token each, as the library's default has it.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.llm.textops import slices

#: The pre-tokenizer's pattern, written out for code points below U+0240.
LATIN_PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ȿ]+| ?[0-9²³¹¼-¾]+"
    r"| ?[^\t-\r \x85\xa00-9²³¹¼-¾A-Za-zªµºÀ-ÖØ-öø-ȿ]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: Texts whose largest UTF-8 byte is no more than this lie below U+0240.
LATIN_LEAD = 0xC8
CACHE_PIECES = 300_000
CACHE_PAIRS = 500_000
#: Text whose pieces are learnt together: the more, the more prefixes they share.
LEARN_BYTES = 4 << 20


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: Latin-1 prints stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceCounts(dict):
    """piece -> tokens, filled by the prefix DP on a miss."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = self.bpe.piece_prefixes(piece.encode())[-1]
        return n


class PrefixBPE:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        stand_in = _byte_alphabet()
        decode = lambda s: bytes(stand_in[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank = [-1] * 256
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(decode, pair if isinstance(pair, list) else pair.split(" "))
            whole = a + b
            if whole not in ids:
                ids[whole] = len(self.rank)
                self.rank.append(rank)
                self.left.append(ids[a])
                self.right.append(ids[b])
            self.joined[ids[a], ids[b]] = rank
        # a token that its own bytes would not be merged into cannot occur
        self.ids = {w: t for w, t in ids.items() if t < 256 or self._apart(self.left[t], self.right[t], self.rank[t])}
        self.longest = max(map(len, self.ids))
        self.fits: dict[tuple[int, int], bool] = {}
        self.counts = PieceCounts(self)
        self.latin = re.compile(LATIN_PIECES)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._library = None

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether tokens a, b stay side by side: going back in time, no merge of what met at their border came before `limit`."""
        rank, left, right, joined = self.rank, self.left, self.right, self.joined
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] >= 0:  # equal ranks: the left one was merged first
                limit, b = rank[b] + 1, left[b]
            else:
                return True

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for each i."""
        count = [0]
        self._extend(piece, [0], count)
        return count

    def _extend(self, piece: bytes, last: list[int], count: list[int]) -> None:
        """Carry the DP on from the prefix that last and count already cover."""
        ids, fits, longest = self.ids, self.fits, self.longest
        for i in range(len(last), len(piece) + 1):
            for s in range(max(0, i - longest), i):
                t = ids.get(piece[s:i])
                if t is None:
                    continue
                if s:
                    pair = (last[s] << 20) | t
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > CACHE_PAIRS:
                            fits.clear()
                        ok = fits[pair] = self._apart(last[s], t, 1 << 60)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[s] + 1)
                break

    def learn(self, pieces: set[str]) -> None:
        """Count new pieces; in sorted order neighbours share the DP of their common prefix."""
        if len(self.counts) + len(pieces) > CACHE_PIECES:
            self.counts.clear()
        before, last, count = b"", [0], [0]
        for piece in sorted(p.encode() for p in pieces):
            k, most = 0, min(len(before), len(piece))
            while k < most and before[k] == piece[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            self._extend(piece, last, count)
            self.counts[piece.decode()] = count[-1]
            before = piece

    def pieces(self, text: str, latin: bool) -> list[str]:
        if latin:
            return self.latin.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def plain_parts(self, text: str) -> list[str]:
        """What stands between special strings, each of which is one token."""
        return self.split_special.split(text) if self.split_special else [text]

    def count(self, text: str, latin: bool) -> int:
        parts = self.plain_parts(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pieces(p, latin))) for p in parts)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for i = 1..len(text), each as if the text ended there."""
        latin = all(c < "ɀ" for c in text)
        out: list[int] = []
        base = 0
        specials = list(self.split_special.finditer(text)) if self.split_special else []
        edges = [(m.start(), m.end()) for m in specials] + [(len(text), len(text))]
        at = 0
        for start, end in edges:
            before = base
            out += [base + n for n in self._plain(text[at:start], latin)]
            base = out[-1] if out else 0
            # inside a special string the prefix is ordinary text that continues what stands since the last one
            for cut in range(start + 1, end):
                out.append(before + self.count(text[at:cut], latin))
            if end > start:
                base += 1
                out.append(base)
            at = end
        return out

    def _plain(self, text: str, latin: bool) -> list[int]:
        out: list[int] = []
        base = at = 0
        run = run_base = 0  # where the white space before the present piece begins, and the tokens before it
        for piece in self.pieces(text, latin):
            if not piece[0].isspace():
                run, run_base = at, base
            inner = self.piece_prefixes(piece.encode())
            size = 0
            for k in range(1, len(piece) + 1):
                size += len(piece[k - 1].encode())
                if k == len(piece) and not piece.isspace():
                    out.append(base + inner[size])
                elif piece[0] == "'" or piece[:k].isspace():  # a shorter text is cut into other pieces here
                    out.append(run_base + sum(map(self.counts.__getitem__, self.pieces(text[run : at + k], latin))))
                else:
                    out.append(base + inner[size])
            at += len(piece)
            base += inner[-1]
            if not piece.isspace():
                run, run_base = at, base
        return out


@functools.cache
def load(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch.column("text"), LEARN_BYTES):
                n_bytes = np.diff(part.bounds)
                data = part.data.tobytes()
                tokens = np.zeros(part.n, np.int64)
                cut: list[list[str]] = []
                for i in range(part.n):
                    own = data[part.bounds[i] : part.bounds[i + 1]]
                    got: list[str] = []
                    for k, plain in enumerate(bpe.plain_parts(own.decode())):
                        tokens[i] += k > 0
                        got += bpe.pieces(plain, max(own, default=0) <= LATIN_LEAD)
                    cut.append(got)
                if new := set().union(*cut) - bpe.counts.keys():
                    bpe.learn(new)
                count = bpe.counts.__getitem__
                for i, got in enumerate(cut):
                    tokens[i] += sum(map(count, got))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, part.n), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and prefix_tokens: element i is the exact token count of the first i code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                lists = [bpe.prefix_counts(t) if t else [] for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "text", "prefix_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, prefix_tokens array<int>")


def tokens_at(n_chars: Column | int) -> Column:
    """Tokens of the first n_chars code points, from a stored prefix table; past the end, of the whole text."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size("prefix_tokens"))
    return F.when(n < 1, 0).otherwise(F.get("prefix_tokens", (n - 1).cast("int")))


def longest_prefix(budget: Column | int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens (counts may fall as a text grows, so all are looked at)."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform("prefix_tokens", lambda n, i: F.when(n <= limit, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))
