"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash over the CUT_SPAN characters before a place says so, inside words as well as
between them; the cuts depend on the content alone, so a passage that stands in many documents falls into the
same chunks in each of them. A worker encodes each distinct chunk once, within a bounded memory of chunks: what
stands between the first and the last plain white space of the chunk. The ends that a cut tore off are repaired:
what is left of the last word of one chunk, whole chunks without white space, and what the next one begins with
are put together and encoded anew, up to the next white space, where the library's own splitting agrees with the
chunks' whatever stands on either side.

The words of chunks that are not in memory are looked up in a bounded memory of pieces (runs that the tokenizer
encodes apart); the unknown ones of a batch go to the library in one call and are told apart by the tokens that
end a word. Both memories have two generations, so that what is used stays; a full memory costs time and never a
result.

Null and empty texts: no tokens, hashes of the empty string. Texts that hold a special token's own string are
encoded whole by the library, as such strings may swallow or split pieces. Very long texts and words are encoded
whole, never cut off. Repeated rows give repeated results, an empty table an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventide.llm.common import pieces

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: A chunk ends where the hash of the CUT_SPAN characters before is 0 modulo CUT_EVERY, LEAST characters after the last cut at the earliest.
CUT_SPAN, CUT_EVERY, LEAST = 8, 256, 32
#: What a generation of a worker's memories holds, and how long a remembered chunk or piece may be: some tens of MB together.
CHUNKS_KEPT, PIECES_KEPT, CHUNK_SIZE, PIECE_SIZE = 4_000, 150_000, 4_096, 128
END = "</w>"


class Memory(dict):
    """What is used stays: when the young generation is full it becomes the old one, and the old one goes."""

    def __init__(self, limit: int) -> None:
        self.limit, self.older = limit, {}

    def find(self, key: str):
        out = self.get(key)
        if out is None and (out := self.older.get(key)) is not None:
            self.keep(key, out)
        return out

    def keep(self, key: str, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value


# For characters below U+0250 and common punctuation, the tokenizer's own splitting pattern can be applied here:
# in these ranges letters, numbers, white space and lower case are the same in every Unicode version. Texts with
# any other character are split at white space only and the library does the rest.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACES = " \t\n\x0b\x0c\r\x85\xa0"
_PLAIN = re.compile("[\u0000-\u012f\u0131-\u024f\u2010-\u2027]*")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def split(text: str) -> list[str]:
    """Pieces of a text that the tokenizer encodes independently of each other."""
    if text.isascii() or _PLAIN.fullmatch(text):
        return _SPLIT.findall(text.lower())
    return [w for w in text.replace("\n", " ").split(" ") if w]


Coded = tuple[int, str, str]  # tokens, their ids joined by spaces, the decoded text


def joined(parts: list[Coded]) -> Coded:
    full = [p for p in parts if p[0]]
    if not full:
        return 0, "", ""
    n, ids, shown = zip(*full, strict=True)
    return sum(n), " ".join(ids), " ".join(shown)


class ChunkCoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.shown = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.ends = frozenset(i for i, t in self.shown.items() if t.endswith(END))
        self.pieces, self.chunks = Memory(PIECES_KEPT), Memory(CHUNKS_KEPT)
        self.reused = self.repaired = 0  # characters of chunks found in memory, words put together across cuts

    def whole(self, text: str) -> Coded:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return len(got.ids), " ".join(map(str, got.ids)), self.tokenizer.decode(got.ids, skip_special_tokens=False)

    def cuts(self, text: str) -> list[int]:
        """Ends of the chunks: content-defined, anywhere."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out, last = [], 0
        if len(codes) > CUT_SPAN:
            h = np.zeros(len(codes) - CUT_SPAN, dtype=np.uint32)
            for k in range(CUT_SPAN):
                h = h * np.uint32(2654435761) + codes[k : k + len(h)]
            h ^= h >> np.uint32(15)
            for at in (np.flatnonzero((h * np.uint32(2246822519) >> np.uint32(8)) % np.uint32(CUT_EVERY) == 0) + CUT_SPAN).tolist():
                if at >= last + LEAST:
                    out.append(at)
                    last = at
        return [*out, len(text)]

    def learn(self, words: set[str]) -> dict[str, Coded]:
        """The codes of words that are not in memory: those of one piece each in one call, the others one by one."""
        plain = [w for w in words if w.isascii() or _PLAIN.fullmatch(w)]
        out: dict[str, Coded] = {}
        if plain:
            ids = self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids
            ends = [k + 1 for k, i in enumerate(ids) if i in self.ends]
            if len(ends) == len(plain) and (not ids or ends[-1] == len(ids)):
                for w, a, b in zip(plain, [0, *ends], ends, strict=False):
                    out[w] = (b - a, " ".join(map(str, ids[a:b])), " ".join([self.shown[i] for i in ids[a:b]]))
        for w in words:
            if w not in out:
                out[w] = self.whole(w)
            if len(w) <= PIECE_SIZE:
                self.pieces.keep(w, out[w])
        return out

    def encode_all(self, texts: list[str]) -> list[Coded]:
        """Chunks and torn words of all texts first, then the unknown words of all at once, then the results."""
        plans: list[Coded | list] = []
        new: dict[str, list[str] | Coded] = {}  # chunk or torn word -> its pieces
        known: dict[str, Coded] = {}  # pieces of this batch
        for text in texts:
            if not text or any(s in text for s in self.special):
                plans.append(self.whole(text) if text else (0, "", ""))
                continue
            plan, begin, torn = [], 0, []
            for end in self.cuts(text):
                chunk = text[begin:end]
                begin = end
                first = min(k for k in (chunk.find(" "), chunk.find("\n"), len(chunk)) if k >= 0)
                if first == len(chunk):
                    torn.append(chunk)
                    continue
                last = max(chunk.rfind(" "), chunk.rfind("\n"))
                word, middle = "".join([*torn, chunk[:first]]), chunk[first : last + 1]
                self.repaired += bool(torn and torn[-1] and first)
                plan += [word, middle]
                torn = [chunk[last + 1 :]]
            plan.append("".join(torn))
            plan = [x for x in plan if x]
            for x in plan:
                if x not in new:
                    old = self.chunks.find(x)
                    if old is None:
                        words = new[x] = split(x)
                        for w in words:
                            if w not in known and (code := self.pieces.find(w)) is not None:
                                known[w] = code
                    else:
                        new[x] = old
                        self.reused += len(x)
                else:
                    self.reused += len(x)
            plans.append(plan)
        known.update(self.learn({w for words in new.values() if isinstance(words, list) for w in words if w not in known}))
        for x, words in new.items():
            if isinstance(words, list):
                new[x] = code = joined([known[w] for w in words])
                if len(x) <= CHUNK_SIZE:
                    self.chunks.keep(x, code)
        return [p if isinstance(p, tuple) else joined([new[x] for x in p]) for p in plans]

    def encode(self, text: str) -> Coded:
        return self.encode_all([text])[0]


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): the digest columns, and with_ids the ids and the decoded text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in pieces(batches, "text", 256 << 10):
            out = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, (n, ids, shown) in zip(batch.column("doc_id").to_pylist(), code.encode_all(texts), strict=True):
                row = (doc, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, [int(x) for x in ids.split()], shown) if with_ids else row)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds[: len(names)], strict=True)], names)

    schema = SCHEMA + ", ids array<int>, decoded string" if with_ids else SCHEMA
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
