"""Byte-level BPE encoding and decoding.

Text is cut into short words by the byte-level pre-tokenizer's pattern. Each
distinct word is merged once by a contiguous rank array: `cuts` holds the part
boundaries, `ranks` the merge rank of every two adjacent parts. The lowest
rank (leftmost on ties) is found by scanning, its inner boundary is deleted,
and the two neighbouring ranks are refreshed. A word longer than LONG bytes
takes a heap over the same arrays, which gives the same merges.

Defined results: a null text counts as empty and has no tokens; an empty text
too. Texts are never cut short. Special tokens' strings inside a text become
their special ids, as the tokenizers library does unless told otherwise.
Repeated rows and repeated ids give a row each. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points whose classes are alike in every Unicode version in use; a text
#: with any other one is cut by the library's own pre-tokenizer.
SETTLED = r"\u0000-\u0557\u2010-\u206f\u20a0-\ua7cd"
#: Bytes of a word from which the heap replaces the scan.
LONG = 200
#: Words remembered by each worker, and the longest that are.
MEMO, MEMO_CHARS = 200_000, 64


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Encoder and decoder built from the JSON of a byte-level BPE tokenizer."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        chars = byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in chars]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.words = regex.compile(PATTERN).findall
        self.odd = regex.compile(f"[^{SETTLED}]").search
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(names) + ")").split if names else None
        self.memo = _Memo(self)
        self.library = None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        if len(word) > LONG:
            return self.merge_long(word)
        merges, ids = self.merges, [self.byte_ids[b] for b in word]
        cuts = list(range(len(word) + 1))
        none = (len(merges), -1)
        ranks = [merges.get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            at = ranks.index(best)
            del cuts[at + 1], ranks[at], ids[at + 1]
            ids[at] = best[1]
            if at < len(ranks):
                ranks[at] = merges.get((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = merges.get((ids[at - 1], ids[at]), none)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges, with the lowest rank kept on a heap."""
        merges, ids = self.merges, [self.byte_ids[b] for b in word]
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(end - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= end or ids[j] != right:
                continue
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < end and (m := merges.get((ids[a], ids[after[a]]))):
                    heapq.heappush(queue, (m[0], a, ids[a], ids[after[a]]))
        return [i for i in ids if i >= 0]

    def cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not self.odd(text):
            return self.words(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        word = memo.__getitem__
        if self.split is None or not any(s in text for s in self.special):
            return b"".join(map(word, self.cut(text)))
        out = []
        for part in self.split(text):
            if part in self.special:
                out.append(_packed([self.special[part]]))
            else:
                out.extend(map(word, self.cut(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of token ids, special tokens included."""
        found = array("I")
        found.frombytes(ids)
        return b"".join(map(self.pieces.__getitem__, found)).decode("utf-8", "replace")


class _Memo(dict):
    """Packed ids of words met lately; long words are not kept."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        packed = _packed(self.bpe.merge(word.encode()))
        if len(word) <= MEMO_CHARS:
            self[word] = packed
        return packed


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


_BUILT: dict[int, Bpe] = {}


def _shared(spec) -> Bpe:
    """One encoder for each worker process and broadcast specification."""
    if spec.id not in _BUILT:
        _BUILT.clear()
        _BUILT[spec.id] = Bpe(spec.value)
    return _BUILT[spec.id]


class _Spec:
    """The tokenizer's JSON, sent to the executors once; its size is that of one vocabulary file."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.sent = spark.sparkContext.broadcast(f.read())
        self.id = self.sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self) -> str:
        return self.sent.value


#: Characters of text handed to one Arrow output batch.
BATCH_CHARS = 4_000_000


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", roundtrip: bool = True) -> DataFrame:
    """One row per row of docs: the id, `token_bytes` (ids as little-endian
    unsigned 32-bit integers) and, with roundtrip, `decoded`, the text read back
    from those ids."""
    spec = _Spec(docs.sparkSession, vocabulary)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("token_bytes", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] * roundtrip

    def batches(it):
        bpe = _shared(spec)
        for batch in it:
            start, held, ids, texts = 0, 0, [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                packed = bpe.encode(text)
                ids.append(packed)
                if roundtrip:
                    texts.append(bpe.decode(packed))
                held += len(text)
                if held >= BATCH_CHARS or row == batch.num_rows - 1:
                    out = [batch.column(0).slice(start, row + 1 - start), pa.array(ids, pa.binary())]
                    out += [pa.array(texts, pa.string())] * roundtrip
                    yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])
                    start, held, ids, texts = row + 1, 0, [], []

    return docs.select(id_col, text_col).mapInArrow(batches, T.StructType(fields))


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", bytes_col: str = "token_bytes") -> DataFrame:
    """One row per row of tokens: the id and `decoded`; null bytes decode to an empty text."""
    spec = _Spec(tokens.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def batches(it):
        bpe = _shared(spec)
        for batch in it:
            texts = [bpe.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return tokens.select(id_col, bytes_col).mapInArrow(batches, schema)
