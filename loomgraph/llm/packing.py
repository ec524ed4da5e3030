"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

An item has a size vector (tokens, one segment, loss-bearing tokens) and a sequence a capacity vector. The dot-product
heuristic fills one sequence at a time: of the waiting items that fit, it places the one whose size, as parts of the
capacity, has the largest dot product with what is left of the sequence, so an item that needs much of what is plentiful
goes first. When tokens are left but no item fits, the best item is cut to fill them and its rest waits on. Items over a
whole sequence give full sequences at once. Each task packs its own rows in pools of ``POOL`` items, without a shuffle;
what is left at a task's end is cut at powers of two, where no padding is due.

Loss-bearing tokens are counted by prefix, so a cut piece bears exactly its own part of them.

Defined cases: null and empty texts have no tokens but their end mark and are packed like others; repeated rows are packed
each; null ids stay null; ties go to the earlier item; an item is never dropped, however long; extra columns are ignored.
If no item can be cut to fill a sequence (the segment or loss limit is met first) the sequence is closed and padded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, per_process, table

MAX_TOKENS, MAX_SEGMENTS, POOL, END_ID = 2048, 128, 1024, 1
#: Words kept in each of two generations; a word that is met again goes over to the new one, so frequent words stay.
WORDS_KEPT = 200_000
#: The same where packing is all that a worker does.
WORDS_KEPT_ALONE = 500_000
#: Texts of these characters only are split here just as the tokenizer splits them, after lower-casing.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\u00c0-\u00ff\u2010-\u2027\u2030-\u205e]*")
# Fixed value: the tokenizer's own split pattern, for those characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Token ids as little-endian uint32 bytes; the ids of a word are found once and kept.

    The tokenizer splits a text into words and marks each word's last token, so many new words are encoded as one text and
    cut at the marks. Texts with other characters than ``PLAIN`` (which may compose or change case in other ways) and texts
    that may hold special tokens are encoded whole.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [SPLIT.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        if len(self.words) > self.kept:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        new = {w for ws in split if ws for w in ws if w not in words}
        if older:
            words.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in words]
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            flat = ids.tobytes()
            words.update(zip(part, (flat[a:z] for a, z in zip([0, *cuts], cuts))))
        return [self.whole(t) if ws is None else b"".join(map(words.__getitem__, ws)) for t, ws in zip(texts, split)]


class Item:
    __slots__ = ("key", "start", "n", "loss")

    def __init__(self, key: int, start: int, n: int, loss: np.ndarray | None):
        self.key, self.start, self.n, self.loss = key, start, n, loss

    def bearing(self, start: int, n: int) -> int:
        return n if self.loss is None else int(self.loss[start + n] - self.loss[start])


class Packer:
    """Streams items in, and pieces ``(key, start, n, sequence, offset)`` out."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, first: int = 0, pool: int = POOL):
        self.cap = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], np.float64)
        self.max_tokens, self.sequence, self.pool = max_tokens, first, pool
        self.waiting: list[Item] = []

    def add(self, key: int, n: int, loss: np.ndarray | None = None) -> Iterator[tuple]:
        """An item of ``n`` tokens; ``loss`` has, for each k from 0 to n, how many of its first k tokens bear loss (None: all)."""
        start, whole = 0, self.max_tokens
        while n - start >= whole and (loss is None or loss[start + whole] - loss[start] <= self.cap[2]) and self.cap[2] >= (whole if loss is None else 0):
            yield key, start, whole, self.sequence, 0
            self.sequence += 1
            start += whole
        if n > start:
            self.waiting.append(Item(key, start, n - start, loss))
        if len(self.waiting) >= self.pool:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        items = self.waiting
        size = np.array([(x.n, 1, x.bearing(x.start, x.n)) for x in items], np.float64).reshape(-1, 3)
        live = np.ones(len(items), bool)
        keep = 0 if last else self.pool // 8
        while live.sum() > keep:
            placed, left = [], self.cap.copy()
            while left[0] > 0 and left[1] > 0 and live.any():
                fits = live & (size <= left).all(1)
                if left[1] == 1 and len(placed) and (live & (size[:, 0] >= left[0])).any():
                    fits &= size[:, 0] >= left[0]
                if fits.any():
                    worth = (size / self.cap) @ (left / self.cap)
                    k = int(np.argmax(np.where(fits, worth, -1)))
                    take = int(size[k, 0])
                else:
                    worth = np.where(live, np.minimum(size[:, 0], left[0]), -1)
                    k = int(np.argmax(worth))
                    take = self._cut(items[k], int(min(left[0], size[k, 0])), left[2])
                    if take <= 0:
                        break
                x = items[k]
                bears = x.bearing(x.start, take)
                placed.append((x.key, x.start, take))
                left -= (take, 1, bears)
                x.start, x.n = x.start + take, x.n - take
                size[k] = x.n, 1, size[k, 2] - bears
                live[k] = x.n > 0
            if not placed:
                raise ValueError("the limits leave no room for a single token")
            yield from self._laid(placed, tail=last and not live.any())
        self.waiting = [x for x, ok in zip(items, live) if ok]

    @staticmethod
    def _cut(item: Item, n: int, loss_left: float) -> int:
        """The most tokens of the item, up to n, that bear no more than the loss left."""
        if item.loss is None:
            return int(min(n, loss_left))
        upto = item.loss[item.start : item.start + n + 1] - item.loss[item.start]
        return int(np.searchsorted(upto, loss_left, side="right")) - 1

    def _laid(self, placed: list[tuple], tail: bool) -> Iterator[tuple]:
        total = sum(p[2] for p in placed)
        room, offset = (1 << (total.bit_length() - 1) if tail and total < self.max_tokens else self.max_tokens), 0
        for key, start, n in placed:
            while n:
                take = min(n, room - offset)
                yield key, start, take, self.sequence, offset
                start, n, offset, total = start + take, n - take, offset + take, total - take
                if offset == room and (n or total):
                    self.sequence, offset = self.sequence + 1, 0
                    room = 1 << (total.bit_length() - 1) if tail else self.max_tokens
        self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, with_ids: bool = False, words_kept: int = WORDS_KEPT) -> DataFrame:
    """Tokenize and pack whole texts; every token bears loss. One row per piece, with its ids if asked for.

    A sequence's id is its task's number and its own number there, so ids are unique and a repeated task gives the same.
    """

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encoder = per_process(f"tokenizer:{words_kept}:{tokenizer}", lambda: WordTokenizer(tokenizer, words_kept))
        packer = Packer(max_tokens, max_segments, first=TaskContext.get().partitionId() << 36)
        held: dict[int, tuple] = {}
        end, key = np.array([END_ID], "<u4").tobytes(), 0
        rows: list[tuple] = []

        def emit(pieces):
            for k, start, n, sequence, offset in pieces:
                doc, ids, left = held[k]
                part = ids[4 * start : 4 * (start + n)]
                rows.append((doc, start, n, zlib.crc32(part), len(ids) // 4, sequence, offset, part if with_ids else None))
                if left == n:
                    del held[k]
                else:
                    held[k] = doc, ids, left - n

        def batch():
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            rows.clear()
            return out if with_ids else out.select(names[:7])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 256):
                part = [t or "" for t in texts[lo : lo + 256].to_pylist()]
                for doc, got in zip(ids[lo : lo + 256], encoder.encode(part)):
                    got += end
                    held[key] = doc, got, len(got) // 4
                    emit(packer.add(key, len(got) // 4))
                    key += 1
                if len(rows) > 20_000:
                    yield batch()
        emit(packer.finish())
        yield batch()

    lean(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack_instructions(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = 32, max_loss: int = 1024) -> DataFrame:
    """Pack whole conversations: turns in order, each ended by the end mark; only the assistant's tokens bear loss.

    Returns a row per piece: ``conv_id, start, length, loss, sequence_id, offset``. Turns of one number go by role and text.
    """
    turn = F.struct(F.col(turn_col).alias("k"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_col).cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = per_process("tokenizer:" + tokenizer, lambda: WordTokenizer(tokenizer))
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 36)
        held, rows, key = {}, [], 0

        def emit(pieces):
            for k, start, n, sequence, offset in pieces:
                conv, upto, left = held[k]
                rows.append((conv, start, n, int(upto[start + n] - upto[start]), sequence, offset))
                if left == n:
                    del held[k]
                else:
                    held[k] = conv, upto, left - n

        def batch():
            cols = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["conv_id", "start", "length", "loss", "sequence_id", "offset"])

        for b in batches:
            for conv, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sizes = [len(x) // 4 + 1 for x in encoder.encode([t["text"] for t in said])]
                bears = np.repeat([t["role"] == "assistant" for t in said], sizes)
                upto = np.concatenate([[0], np.cumsum(bears)])
                held[key] = conv, upto, len(bears)
                emit(packer.add(key, len(bears), upto))
                key += 1
            yield batch()
        emit(packer.finish())
        yield batch()

    return convs.mapInArrow(run, "conv_id bigint, start bigint, length bigint, loss bigint, sequence_id bigint, offset bigint")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_vector_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe_path(), words_kept=WORDS_KEPT_ALONE)
