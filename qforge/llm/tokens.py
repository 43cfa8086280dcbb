"""Token files: documents as token ids, entropy-coded in independent blocks with a shared static rANS model.

Layout of a token file (a folder, so that tasks write their parts at the same time):

* ``model``  one row: bits, vocab and the quantised frequency of each id (they sum to 2 ** bits), from the counts of all ids;
* ``blocks`` one row a block, in ascending doc_id order: shard, block, lanes, the words of its rANS stream and its segments;
* ``shards`` one row a shard: the tokens before it, and how many of its segments hold part of a document.

A block interleaves ``lanes`` rANS coders: a step codes one token of every lane with NumPy. States are 63-bit, renormalised by 32-bit words.
A block is a run of segments of whole documents, and a segment starts at a checkpoint: the states of all lanes and the place in the words. So every
segment is decoded by itself, in any task. A document longer than two segments is cut into segments of its own, which are put together again after decoding.

Checksums: ``crc`` of a segment is over everything stored of it (numbers, ids and lengths of its documents, states, words), ``ids_crc`` over
its decoded ids; the rows of ``model`` and ``shards`` have a crc of their own.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qforge.llm.common import drop_path, kept_by, release_shuffles, scratch, written

END_ID = 0
MODEL_BITS = 18
LOW = np.uint64(1 << 31)
LANES = 2048
SEGMENT_TOKENS = 1 << 17
BLOCK_SEGMENTS = 4
#: Pieces of text whose ids a Python worker keeps; beyond about that many it starts anew.
CACHE_PIECES = 800_000

SEGMENT = "first long, n_tokens long, n_docs int, part int, parts int, doc_ids binary, null_ids binary, lengths binary, states binary, word_from int, word_to int, crc long, ids_crc long"
BLOCKS = f"shard int, block int, lanes int, words binary, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ', ')}>>"
SHARDS = "shard int, start long, cut long, crc long"

# -- tokenising -----------------------------------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, with the ids of recurring pieces kept.

    Byte-level BPE merges only inside the pre-tokens of its fixed pattern. Before a space or line feed that follows other
    text, after a single line feed, and between a letter or digit and a comma or full stop, one pre-token always ends and another
    starts; so a text can be cut there, and only pieces not seen before go to the tokenizers library. Texts where such
    a place may not end a pre-token (unsafe) are encoded by the library in one piece.
    """

    #: White space of other kinds, and a comma or full stop after neither a letter, digit or white space.
    RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    #: Letters and the ASCII marks behind them: the pre-token of the letters ends between the two.
    WORD_AND_MARKS = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-^`{-~].*)", re.S)
    LOOSE = re.compile(r"[.,](?<=[^\w\s].)")
    #: Latin letters after at most one space: one pre-token, whatever stands around it.
    WORD = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([END_ID], dtype=self.dtype).tobytes()
        self.kept: dict[str, bytes] = {"": b""}
        own = self.tokenizer.pre_tokenizer
        self.merges = self.tokenizer.model
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Whether a word's ids are those of the model alone: nothing is normalised, put in front, or a token by itself before the model sees it.
        self.direct = isinstance(self.merges, models.BPE) and isinstance(own, pre_tokenizers.ByteLevel) and not own.add_prefix_space and self.tokenizer.normalizer is None and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        self.feed = (self.tokenizer.encode("\n", add_special_tokens=False).ids or [-1])[0]

    def library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, pieces: list[str]) -> list[bytes]:
        """``library`` for pieces: those without white space but in front go as lines of one text. A line feed is a pre-token of its own there, and what is before and behind it
        is cut as at the ends of a text."""
        plain = [p for p in pieces if p.strip() and "\n" not in p]
        ids = np.frombuffer(self.library(["\n".join(plain)])[0], self.dtype)
        cuts = np.flatnonzero(ids == self.feed)
        if len(cuts) != len(plain) - 1:
            return self.library(pieces)
        data, size = ids.tobytes(), self.dtype.itemsize
        ends = [*(cuts * size).tolist(), len(data)]
        found = dict(zip(plain, [data[a:b] for a, b in zip([0, *(e + size for e in ends[:-1])], ends, strict=True)], strict=True))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self.library(rest), strict=True))
        return [found[p] for p in pieces]

    def words(self, words: list[str]) -> Iterator[bytes]:
        """``library`` for words of Latin letters: the model's merges on each, without looking for pre-tokens first."""
        merges, code = self.merges.tokenize, self.code
        spelled = self.letters.pre_tokenize_str("\n".join(words))[0][0].split(self.letters.pre_tokenize_str("\n")[0][0]) if words else []
        return (array(code, [t.id for t in merges(w)]).tobytes() for w in spelled)

    def unsafe(self, text: str) -> bool:
        if text[0] in " \n.," or "_" in text or "\0" in text or "  " in text or " \n" in text or " ." in text or " ," in text or "\n " in text or "\n\n" in text or "\n." in text or "\n," in text:
            return True
        return bool(self.LOOSE.search(text) or self.RARE.search(text))

    def learn(self, missed: list[str]) -> None:
        """Keep the ids of pieces not seen before."""
        kept, parts = self.kept, {}
        if self.direct:
            plain = list(filter(self.WORD.fullmatch, missed))
            kept.update(zip(plain, self.words(plain), strict=True))
            missed = list(filterfalse(kept.__contains__, missed))
        for p in missed:
            if m := self.WORD_AND_MARKS.fullmatch(p):
                parts[p] = m.groups()
        new = [p for p in {*(p for p in missed if p not in parts), *(x for pair in parts.values() for x in pair)} if p not in kept]
        for s in range(0, len(new), 4096):
            kept.update(zip(new[s : s + 4096], self.lines(new[s : s + 4096]), strict=True))
        for p, (word, marks) in parts.items():
            kept[p] = kept[word] + kept[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, with the end id."""
        if len(self.kept) > CACHE_PIECES:
            self.kept = {"": b""}  # frequent pieces are soon back
        out, cut, whole, seen = [self.end] * len(texts), {}, [], set()
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.unsafe(t):
                whole.append(i)
                continue
            cut[i] = t.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.").split("\0")
            seen.update(cut[i])
        kept = self.kept
        self.learn(list(filterfalse(kept.__contains__, seen)))
        near = dict(zip(seen, map(kept.__getitem__, seen), strict=True))  # small enough for the processor's cache
        for i, pieces in cut.items():
            out[i] = b"".join(map(near.__getitem__, pieces)) + self.end
        for i, ids in zip(whole, self.library([texts[i] for i in whole]), strict=True):
            out[i] = ids + self.end
        return out


def _encoder(path: str | None) -> Encoder:
    """One for each Python worker, which Spark reuses over tasks."""
    path, known = path or default_tokenizer(), kept_by("tokens")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned integers (16 bits if the vocabulary fits), end id appended; null text: the end id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.iloc[s : s + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": encoder.encode(part["text"].tolist())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids binary")


# -- rANS -----------------------------------------------------------------------------------------------------------


def quantise(counts: np.ndarray, bits: int = MODEL_BITS) -> np.ndarray:
    """Frequencies that sum to 2 ** bits, at least 1 for each id that occurs."""
    total, goal = int(counts.sum()), 1 << bits
    if not total:
        raise ValueError("no ids to model")
    share = counts.astype(np.float64) * goal / total
    freq = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    over = int(freq.sum()) - goal
    order = np.argsort(-freq, kind="stable")
    while over:  # the rounding is taken from, or given to, the most frequent ids
        for i in order[: max(1, min(abs(over), int((freq > 1).sum()) or 1))]:
            if over > 0 and freq[i] > 1:
                step = min(over, max(1, int(freq[i]) // 64))
                freq[i] -= step
                over -= step
            elif over < 0:
                freq[i] -= over
                over = 0
            if not over:
                break
    return freq.astype(np.uint64)


def encode_block(parts: list[np.ndarray], freq: np.ndarray, cum: np.ndarray, bits: int = MODEL_BITS) -> tuple[int, bytes, list[tuple[bytes, int, int]]]:
    """(lanes, words, (states, first word, end of words) of each part) of one block. A part starts on lane 0; its states are its checkpoint."""
    lanes = int(min(LANES, max(1, sum(map(len, parts)) // 64)))
    k, w, low = np.uint64(bits), np.uint64(32), np.uint64(0xFFFFFFFF)
    x = np.full(lanes, LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    marks = []
    for ids in reversed(parts):  # the decoder goes forward
        n, before = len(ids), sum(map(len, out))
        f, c = freq[ids], cum[ids]
        limit = f << np.uint64(63 - bits)
        for a in range((n - 1) // lanes * lanes, -1, -lanes):
            b = min(n, a + lanes)
            y = x[: b - a]
            big = y >= limit[a:b]
            if big.any():
                out.append((y[big] & low).astype("<u4"))
                y = np.where(big, y >> w, y)
            q = y // f[a:b]
            x[: b - a] = (q << k) + (y - q * f[a:b]) + c[a:b]
        marks.append((x.astype("<u8").tobytes(), sum(map(len, out)) - before))
    checkpoints, at = [], 0
    for states, n in reversed(marks):
        checkpoints.append((states, at, at + n))
        at += n
    return lanes, b"".join(o.tobytes() for o in reversed(out)), checkpoints


def decode_segment(n: int, lanes: int, states: bytes, words: bytes, model: Model) -> np.ndarray:
    """The n ids of a segment, from its checkpoint and its words."""
    k, w, mask, low = np.uint64(model.bits), np.uint64(32), np.uint64((1 << model.bits) - 1), np.uint64(0xFFFFFFFF)
    x, word, slots, table = np.frombuffer(states, "<u8").astype(np.uint64), np.frombuffer(words, "<u4"), model.slots, model.table
    out, at = np.empty(n, dtype=slots.dtype), 0
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        y = x[: b - a]
        slot = y & mask
        ids = slots.take(slot.view(np.int64))
        out[a:b] = ids
        both = table.take(ids)
        y = (both >> w) * (y >> k) + slot - (both & low)
        under = np.flatnonzero(y < LOW)
        if len(under):
            y[under] = (y[under] << w) | word[at : at + len(under)]
            at += len(under)
        x[: b - a] = y
    return out


class Model:
    def __init__(self, freq: bytes, bits: int):
        self.bits, self.freq = bits, np.frombuffer(freq, "<u4").astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)

    @cached_property
    def slots(self) -> np.ndarray:
        """The id of each of the 2 ** bits slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))

    @cached_property
    def table(self) -> np.ndarray:
        """Frequency and start of each id in one number."""
        return (self.freq << np.uint64(32)) | self.cum


# -- writing and reading --------------------------------------------------------------------------------------------


def count_ids(tokens: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs in all documents; each task sends one sum for each id it saw."""
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocab, dtype=np.int64)
        for b in batches:
            for s in range(0, len(b), 500):
                total += np.bincount(np.frombuffer(b"".join(b["ids"].iloc[s : s + 500]), dtype), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    rows = tokens.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # vocab rows at most
    counts = np.zeros(vocab, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def _crc(numbers: tuple, *binaries: bytes) -> int:
    crc = zlib.crc32(np.array(numbers, dtype="<i8").tobytes())
    for x in binaries:
        crc = zlib.crc32(x, zlib.crc32(len(x).to_bytes(8, "little"), crc))
    return crc


def _segment_crc(shard: int, block: int, lanes: int, s: dict, words: bytes) -> int:
    numbers = (shard, block, lanes, *(s[k] for k in ("first", "n_tokens", "n_docs", "part", "parts", "word_from", "word_to", "ids_crc")))
    return _crc(numbers, *(s[k] for k in ("doc_ids", "null_ids", "lengths", "states")), words)


class BlockWriter:
    """Collects the documents of one shard into segments and blocks."""

    def __init__(self, shard: int, model: Model):
        self.shard, self.model, self.block, self.at = shard, model, 0, 0
        self.segments: list[tuple[dict, np.ndarray]] = []
        self.docs: list[tuple[object, np.ndarray]] = []
        self.held = 0

    def close(self, docs: list[tuple[object, np.ndarray]], ids: np.ndarray, first: int, part: int = 0, parts: int = 1) -> None:
        null = [d is None or d != d for d, _ in docs]
        self.segments.append(({
            "first": first, "n_tokens": len(ids), "n_docs": len(docs), "part": part, "parts": parts,
            "doc_ids": np.array([0 if n else int(d) for n, (d, _) in zip(null, docs, strict=True)], dtype="<i8").tobytes(), "null_ids": np.packbits(null).tobytes(),
            "lengths": np.array([len(x) for _, x in docs], dtype="<i8").tobytes(), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes()),
        }, ids))

    def close_docs(self) -> None:
        if self.docs:
            self.close(self.docs, np.concatenate([x for _, x in self.docs]), self.at - self.held)
        self.docs, self.held = [], 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(ids) > 2 * SEGMENT_TOKENS:
            self.close_docs()
            cuts = range(0, len(ids), SEGMENT_TOKENS)
            for i, c in enumerate(cuts):
                self.close([(doc_id, ids)], ids[c : c + SEGMENT_TOKENS], self.at, i, len(cuts))
                yield from self.flush(BLOCK_SEGMENTS)
            self.at += len(ids)
            return
        self.docs.append((doc_id, ids))
        self.held, self.at = self.held + len(ids), self.at + len(ids)
        if self.held >= SEGMENT_TOKENS:
            self.close_docs()
            yield from self.flush(BLOCK_SEGMENTS)

    def flush(self, least: int = 1) -> Iterator[pd.DataFrame]:
        if len(self.segments) < least:
            return
        lanes, words, checkpoints = encode_block([ids for _, ids in self.segments], self.model.freq, self.model.cum, self.model.bits)
        rows = []
        for (s, _), (states, a, b) in zip(self.segments, checkpoints, strict=True):
            s |= {"states": states, "word_from": a, "word_to": b}
            rows.append(s | {"crc": _segment_crc(self.shard, self.block, lanes, s, words[4 * a : 4 * b])})
        yield pd.DataFrame({"shard": [self.shard], "block": [self.block], "lanes": [lanes], "words": [words], "segments": [rows]})
        self.block, self.segments = self.block + 1, []


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the token file of all documents in ascending doc_id order (null ids first) and return its path.

    Null and empty texts become their end id alone. Rows that repeat are written as often as they occur. An empty table
    makes a file without blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocab = _encoder(tokenizer).vocab
    wide = "<u2" if vocab <= 1 << 16 else "<u4"
    staged, staged_path = written(tokenize(docs, tokenizer, id_col, text_col), "ids")
    counts = count_ids(staged, vocab)
    counts[END_ID] += 1  # the model of an empty table
    freq = quantise(counts).astype("<u4").tobytes()
    spark.createDataFrame([(MODEL_BITS, vocab, bytearray(freq), _crc((MODEL_BITS, vocab), freq))], "bits int, vocab int, freq binary, crc long").coalesce(1).write.parquet(f"{path}/model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = BlockWriter(TaskContext.get().partitionId(), Model(freq, MODEL_BITS))
        for b in batches:
            for doc_id, ids in zip(b["doc_id"].astype(object), b["ids"], strict=True):
                yield from writer.add(doc_id, np.frombuffer(ids, wide))
        writer.close_docs()
        yield from writer.flush()

    staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").mapInPandas(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    segments = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", F.explode("segments").alias("s"))
    totals = segments.groupBy("shard").agg(F.sum("s.n_tokens").alias("n"), F.count_if(F.col("s.parts") > 1).alias("cut"))
    offsets = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("start"), "cut")  # a row a shard
    offsets.withColumn("crc", F.crc32(F.concat_ws(",", "shard", "start", "cut"))).coalesce(1).write.parquet(f"{path}/shards")
    drop_path(spark, staged_path)
    release_shuffles(spark)
    return path


def read_model(spark: SparkSession, path: str) -> tuple[bytes, int]:
    bits, vocab, freq, crc = spark.read.parquet(f"{path}/model").select("bits", "vocab", "freq", "crc").first()
    if _crc((bits, vocab), freq := bytes(freq)) != crc:
        raise ValueError("damaged model")
    return freq, bits


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decode a token file, segments in parallel, each from its checkpoint: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), or with ``digest``
    their CRC instead (ids_crc32 long). Bad checksums raise."""
    name, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    given = zlib.crc32 if digest else bytes
    freq, bits = read_model(spark, path)

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        model = Model(freq, bits)
        for b in batches:
            for r in b.to_dict("records"):
                where = f"segment {r['segment']} of block {r['shard']}/{r['block']}"
                if _segment_crc(r["shard"], r["block"], r["lanes"], r, r["words"]) != r["crc"]:
                    raise ValueError(f"damaged {where}")
                ids = decode_segment(r["n_tokens"], r["lanes"], r["states"], r["words"], model).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["ids_crc"]:
                    raise ValueError(f"{where} decodes to other ids")
                n = np.frombuffer(r["lengths"], "<i8")
                doc_ids = pd.array(np.frombuffer(r["doc_ids"], "<i8"), dtype="Int64")
                doc_ids[np.unpackbits(np.frombuffer(r["null_ids"], np.uint8), count=len(n)).astype(bool)] = pd.NA
                yield r, doc_ids, n, ids

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, doc_ids, n, ids in decoded(batches):
            ends, data = np.cumsum(n), ids.tobytes()
            pieces = [given(data[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": doc_ids, "start": r["start"] + r["first"] + ends - n, "n_tokens": n, name: pieces})

    def cut_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, doc_ids, n, ids in decoded(batches):
            yield pd.DataFrame({"doc_id": doc_ids, "start": r["start"] + r["first"], "n_tokens": n, "ids": [ids.tobytes()], "part": r["part"]})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        ids = b"".join(rows["ids"])
        if len(ids) != 4 * rows["n_tokens"].iloc[0]:
            raise ValueError("a part of a document is missing")
        return rows.iloc[:1][["doc_id", "start", "n_tokens"]].assign(**{name: [given(ids)]})

    blocks, shards = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sound, cut = shards.agg(F.bool_and(F.col("crc") == F.crc32(F.concat_ws(",", "shard", "start", "cut"))), F.sum("cut")).first()
    if sound is False:
        raise ValueError("damaged shards")
    segments = blocks.join(F.broadcast(shards.select("shard", "start")), "shard").select("shard", "block", "lanes", "start", "words", F.posexplode("segments").alias("segment", "s"))  # a row of 12 bytes a shard
    words = F.substr("words", F.col("s.word_from") * 4 + 1, (F.col("s.word_to") - F.col("s.word_from")) * 4)
    segments = segments.select("shard", "block", "lanes", "start", "segment", words.alias("words"), "s.*")
    document = f"doc_id long, start long, n_tokens long, {name} {kind}"
    out = segments.filter("parts = 1").mapInPandas(documents, document)
    if cut:
        out = out.union(segments.filter("parts > 1").mapInPandas(cut_documents, "doc_id long, start long, n_tokens long, ids binary, part int").groupBy("start").applyInPandas(together, document))
    return out


def token_digest(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token file of ``docs`` in the shared folder, read it back, and give of each document what the file holds:
    doc_id, start, n_tokens, ids_crc32.

    One row per document row, null ids first, then in ascending order of id; rows that repeat an id are in the order of their ids' bytes. Null and empty texts are their end id
    alone. An empty table gives no rows. Other columns are ignored.
    """
    path = write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer, id_col, text_col)
    return read_tokens(docs.sparkSession, path, digest=True)
