"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Method. Each pack of documents is cut into pre-tokens (by arithmetic on character classes, see :func:`pre_tokens`) and sends every distinct
one once to a bucket by its hash. A bucket sees each distinct pre-token of the corpus, encodes it once and answers every pack that
asked with ids in the order of its question. The pack joins the ids back by pre-token and puts them in order by position. Decoding
looks each id up in the token-byte table (one entry per rank, a size fixed by the tokenizer).

Nothing is a special token. Rows: every input row gives one row; null text counts as empty; repeated ids are kept apart; other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packs as P
from . import _prints as R

#: Larger packs than elsewhere: the share of distinct words falls with the size.
PACK_BYTES = 4 << 20
#: The pattern that :func:`pre_tokens` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE = range(4)
OUT = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.binary()), ("decoded", pa.binary())])
SCHEMA = "doc_id long, token_ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 of the token's bytes and its rank in each line. Read on the driver, where the path is."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the pattern sees it."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@functools.lru_cache(maxsize=2)
def encoder(table: tuple[bytes, ...]) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(table)}, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(table: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and where each token's begin and how many they are."""
    n = np.array([len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(n) - n, n


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start in some texts, and each text's first one (``n + 1`` positions).

    Runs of one class are pre-tokens. A run of white space before something else leaves its last sign apart; if that is a blank it goes with
    what follows. An apostrophe that starts a pre-token takes ``s t m d re ve ll`` with it.
    """
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    byte = np.cumsum(width) - width
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(byte, offsets)] = True  # the end counts as one, too
    kind = classes()[code]
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = code == 0x20
    after_blank = np.r_[False, blank[:-1]] & ~first[:-1]
    start = run & ~((kind != SPACE) & after_blank)
    # The last sign of white space that something else follows in the same text.
    last = (kind == SPACE) & np.r_[kind[1:] != SPACE, False] & ~first[1:]
    start |= last
    at = np.flatnonzero((code == 0x27) & start & run & ~first[1:])
    at = at[kind[at + 1] == LETTER]
    if len(at):
        one, two = code[at + 1], np.where(first[np.minimum(at + 2, n)], 0, code[np.minimum(at + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        at, size = at[short | long], np.where(short, 2, 3)[short | long]
        start[at + 1] = False
        follow = at + size
        follow = follow[follow < n]
        start[follow[kind[follow] == LETTER]] = True
    begin = byte[start]
    return begin, np.searchsorted(begin, offsets)


class Words:
    """A pack's distinct pre-tokens in the order of their fingerprints, and each text's pre-tokens as numbers of these.

    Fingerprints only find what may be equal: every pre-token is compared with the one that stands for it, byte by byte.
    """

    def __init__(self, table: pa.Table):
        self.data, self.offsets = P.texts(table)
        start, end, bounds, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        for a, b in P.chunks(self.offsets):
            at = self.offsets[a : b + 1] - self.offsets[a]
            begin, first = pre_tokens(self.data[self.offsets[a] : self.offsets[b]], at)
            stop = np.r_[begin[1:], at[-1:]] if len(begin) else begin
            start.append(begin + self.offsets[a]), end.append(stop + self.offsets[a]), bounds.append(first[1:] + total)
            total += len(begin)
        self.bounds, start, end = np.concatenate(bounds), np.concatenate(start), np.concatenate(end)
        self.prints, some, self.number = R.numbered(self.data, start, end)
        self.start, self.end = start[some], end[some]


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Per document: ``doc_id, token_ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (the bytes of these tokens)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])))
    kind = np.uint16 if len(ranks) <= 1 << 16 else np.uint32
    n = P.bucket_count(P.text_bytes(docs))
    packs = P.packed(docs, pack_bytes)

    def ask(pack, table):
        x = Words(table)
        press = zstandard.ZstdCompressor(6).compress
        for b, s in P.slices(x.prints, n).items():
            size = x.end[s] - x.start[s]
            yield b, press(np.array([len(size)], np.uint32).tobytes() + size.astype(np.uint32).tobytes() + x.data[R.ranges(x.start[s], x.end[s])].tobytes())

    def answer(bucket, rows):
        encode, known, press, unpress = encoder(shared.value)._encode_single_piece, {}, zstandard.ZstdCompressor(6).compress, zstandard.ZstdDecompressor().decompress
        for pack, blob in rows:
            blob = unpress(blob)
            [m] = np.frombuffer(blob, np.uint32, 1)
            ends = (np.cumsum(np.frombuffer(blob, np.uint32, m, 4), dtype=np.int64) + 4 + 4 * int(m)).tolist()
            words = [blob[a:b] for a, b in zip([4 + 4 * int(m), *ends], ends, strict=False)]
            for w in words:
                if w not in known:
                    known[w] = np.array(encode(w), kind).tobytes()
            ids = [known[w] for w in words]
            yield pack, press(np.array([len(i) for i in ids], np.uint32).tobytes() + b"".join(ids))

    def join(pack, table, told):
        x = Words(table)
        at, unpress = P.slices(x.prints, n), zstandard.ZstdDecompressor().decompress
        count, ids = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
        for b, blob in sorted(told[0].items()):
            blob = unpress(blob)
            m = at[b].stop - at[b].start
            count.append(np.frombuffer(blob, np.uint32, m).astype(np.int64) // ids[0].itemsize)
            ids.append(np.frombuffer(blob, kind, -1, 4 * m))
        count, ids = np.concatenate(count), np.concatenate(ids)
        where = np.cumsum(count) - count
        flat, begin, size = token_bytes(shared.value)
        coded, decoded = [], []
        for a, b in P.chunks(x.offsets):
            number = x.number[x.bounds[a] : x.bounds[b]]
            run = ids[R.ranges(where[number], where[number] + count[number])].astype("<u4")
            ends = np.r_[0, np.cumsum(count[number])][x.bounds[a : b + 1] - x.bounds[a]]
            raw = flat[R.ranges(begin[run], begin[run] + size[run])]
            stops = np.r_[0, np.cumsum(size[run])][ends]
            coded += [run[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            decoded += [raw[i:j].tobytes() for i, j in zip(stops[:-1], stops[1:], strict=True)]
        return pa.table({"doc_id": table.column("doc_id"), "token_ids": pa.array(coded, pa.binary()), "decoded": pa.array(decoded, pa.binary())})

    return P.apply(packs, [P.answer(P.ask(packs, ask), answer)], join, SCHEMA, OUT)


def op4_bpe(spark, sf_dir: str, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    done = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_ranks(public_tokenizers.path(name)))
    return done.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
