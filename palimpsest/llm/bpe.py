"""BPE encoding and decoding with a pair occurrence index.

A task takes its documents in blocks. A block's distinct words are laid end
to end as symbols, and every pair of neighbours that has a rank is filed under
it with all its positions. The least active rank is applied to all its
positions at once, and the pairs that this makes are filed in their turn. A
heap holds the active ranks; a position whose pair has changed meanwhile is
passed over. Words don't touch each other, so each is merged in the order in
which it would be alone.

The vocabulary file is of the tokenizers library: NFC, white space runs to one
space, lower case, the words of ``WORD``, bytes as characters, ``</w>`` on the
last, no decoder (tokens are joined by a space). Added tokens are found in the
raw text first.

Null and empty texts have no tokens and decode to the empty string. Repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import documents

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space runs other than one space.
SPACES = regex.compile(r" \s+|[^\S ]\s*")
END = "</w>"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in prints else chr(spare))
        spare += b not in prints
    return out


def normalized(text: str) -> str:
    """NFC, white space runs to one space, each character lowered by itself."""
    if text.isascii():
        return SPACES.sub(" ", text).lower() if "\x1c" > min(text, default="~") else text.lower()
    text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


#: What a vocabulary file must say for this encoder, which follows it, to be right.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def check_file(spec: dict) -> None:
    """Refuses a file of another normalizer, pre-tokenizer, decoder, model or kind of added tokens."""
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    wrong = [
        name
        for name, right in (
            ("normalizer", (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS),
            ("pre_tokenizer", len(before) == 2 and before[0].get("pattern") == {"Regex": WORD.pattern} and before[0].get("behavior") == "Removed" and before[0].get("invert") is True and before[1] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}),
            ("decoder", spec.get("decoder") is None),
            ("post_processor", spec.get("post_processor") is None),
            ("model", all(spec["model"].get(k) == v for k, v in MODEL.items())),
            ("added_tokens", not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))),
        )
        if not right
    ]
    if wrong:
        raise ValueError(f"a vocabulary file with another {', '.join(wrong)}: this encoder would give other ids than its library")


class PairIndexBpe:
    """Merges of one vocabulary file, applied to many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_file(spec)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.final = np.array([vocab[c + END] for c in characters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = len(self.tokens)
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair a, b; -1 if they never merge."""
        wanted = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (a >= 0) & (b >= 0), self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and how many each word has. No word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        symbol = np.append(self.inner[data], -1)
        last = np.cumsum(sizes) - 1
        symbol[last] = self.final[data[last]]
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[last] = n  # the sentinel, whose symbol is -1
        prv[last[:-1] + 1] = n
        if n:
            prv[0] = n
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(heap, r)

        file(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[nxt[at]] == b)]
            if not len(at):
                continue
            if a == b:  # of xxx the first two merge
                follows = np.r_[False, nxt[at[:-1]] == at[1:]]
                begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = nxt[at]
            symbol[at] = self.made[r]
            symbol[gone] = -2
            after = nxt[gone]
            nxt[at] = after
            prv[after] = at  # the sentinel's own is never read
            before = prv[at]
            file(np.unique(np.concatenate([before[before < n], at])))
        alive = symbol[:n] >= 0
        counts = np.add.reduceat(alive.astype(np.int64), np.r_[0, last[:-1] + 1]) if n else np.zeros(0, np.int64)
        return symbol[:n][alive], counts


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


class Coder:
    """Encodes chunks between spaces, each distinct one once as long as it is remembered."""

    REMEMBERED = 250_000

    def __init__(self, path: str):
        self.bpe = PairIndexBpe(path)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.bpe.added, key=len, reverse=True)) + ")") if self.bpe.added else None
        self.leads = sorted({t[:2] for t in self.bpe.added})
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def special_chunks(self, text: str) -> list[str] | None:
        """The chunks of a text that holds added tokens, each of these led by a space, which begins no other; None if it holds none."""
        if self.special is None or not any(x in text for x in self.leads) or not self.special.search(text):
            return None
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [" " + part] if k % 2 else [c for c in normalized(part).split(" ") if c]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Ids and decoded tokens of distinct chunks, as strings."""
        if len(self.ids) > self.REMEMBERED:
            keep = [c for c in chunks if c in self.ids]
            self.ids, self.decoded = {c: self.ids[c] for c in keep}, {c: self.decoded[c] for c in keep}
        order = [c for c in chunks if c not in self.ids]
        split = [[] if c[:1] == " " else WORD.findall(c) for c in order]
        words = list({w for s in split for w in s})
        ids, counts = self.bpe.encode([w.encode() for w in words])
        listed, names = list(map(str, ids.tolist())), [self.bpe.tokens[i] for i in ids.tolist()]
        of = {}
        start = 0
        for w, end in zip(words, np.cumsum(counts).tolist(), strict=True):
            of[w] = (" ".join(listed[start:end]), " ".join(names[start:end]))
            start = end
        for c, s in zip(order, split, strict=True):
            if len(s) == 1:
                self.ids[c], self.decoded[c] = of[s[0]]
            elif s:
                self.ids[c], self.decoded[c] = (" ".join(x) for x in zip(*(of[w] for w in s), strict=True))
            elif c[:1] == " ":
                self.ids[c], self.decoded[c] = str(self.bpe.added[c[1:]]), c[1:]
            else:
                self.ids[c] = self.decoded[c] = ""


ENCODED = "doc_id long, n_tokens long, ids string, decoded string"


def _encode(path: str, block_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def finish(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        apart = {i: chunks for i, t in enumerate(texts) if (chunks := own.special_chunks(t)) is not None}
        if apart:
            own.learn(list(set().union(*apart.values())))
            listed = [[" ".join([x for x in map(of.__getitem__, c) if x]) for c in apart.values()] for of in (own.ids, own.decoded)]
            yield counted([ids[i] for i in apart], *(pa.array(x, pa.string()) for x in listed))
            ids, texts = ([x for i, x in enumerate(y) if i not in apart] for y in (ids, texts))
        if texts:
            # Arrow splits, finds the distinct chunks, and puts their ids in the chunks' places.
            parts = pc.split_pattern(pa.array([normalized(t).strip(" ") for t in texts], pa.string()), " ")
            coded = parts.flatten().dictionary_encode()
            chunks = coded.dictionary.to_pylist()
            own.learn(chunks)
            joined = []
            for of in (own.ids, own.decoded):
                placed = pa.array(map(of.__getitem__, chunks), pa.string(), size=len(chunks)).take(coded.indices)
                whole = pc.binary_join(pa.ListArray.from_arrays(parts.offsets.cast(pa.int32()), placed), " ")
                if not all(map(of.__getitem__, chunks)):  # chunks without tokens
                    whole = pc.utf8_trim(pc.replace_substring_regex(whole, " +", " "), " ")
                joined.append(whole)
            for at in range(0, len(texts), 1000):
                yield counted(ids[at : at + 1000], *(x.slice(at, 1000).cast(pa.string()) for x in joined))

    def counted(ids: list, listed: pa.Array, decoded: pa.Array) -> pa.RecordBatch:
        n = pc.add(pc.count_substring(listed, " "), pc.cast(pc.not_equal(listed, ""), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), n.cast(pa.int64()), listed, decoded], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(text or "")
                if held >= block_chars:
                    yield from finish(ids, texts)
                    ids, texts, held = [], [], 0
        yield from finish(ids, texts)
        # The worker process lives on and may serve other stages.
        coder(path).ids, coder(path).decoded = {}, {}
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, path: str, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space) and decoded, a row for each row of ``docs``.

    A task holds ``block_chars`` characters of text at a time, or one longer text.
    """
    return documents(docs).mapInArrow(_encode(path, block_chars), ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
