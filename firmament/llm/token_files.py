"""Token ids of texts as Parquet files, in id order, read back in part.

``write`` lays down two tables under one folder.  ``tokens`` has a row per
document: its id, its file's number, the number of ids before it in that file,
its own number of ids and the list of ids.  The list column is dictionary
encoded (a vocabulary fits one dictionary page), the whole-number columns are
delta encoded, row groups have a set size and pages few rows, and every page
has an entry in the file's page index.  ``files`` has a row per file: how many
ids all files before it hold, and the first and last document id.

So what a reader wants costs what it wants: ``documents`` reads no ids,
``of_ids`` and ``of_range`` reach for the pages that hold the documents named
or the positions asked for.

Documents are spread over files by ranges of (id, hash of the text, position
in the input), so a repeated id is split like any other, and sorted by (id,
hash, text) within a file; rows equal in both are interchangeable.  Input
positions are those of the scan: give a table read from files.

Texts are encoded a stretch between white space at a time, each stretch once
while remembered, if the tokenizer's file shows that it always parts words
(``spaces_part``); else whole.  If it always parts letters from signs too
(``signs_part``), a word with signs after it has the ids of the word, then those
of the signs, and so a word is encoded once whatever follows it and, if the
tokenizer lower-cases, however it is written.  The ids are the same in all cases.
A worker's memory is bounded: it remembers words and signs, not what is put
together of them, up to a set number and size, and then the last ones used only;
ids are put in place for a part of the texts at a time.

Defined results: a null text is empty, an empty text has the end id only; null
ids come first; repeated rows each get a row; texts of any length are read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmament.llm.store import small

REMEMBERED = 600_000  # words, signs and stretches a Python worker keeps the ids of
KEPT = 48 << 20  # bytes of these and of their ids
GROUP = 256  # stretches encoded as one text
# letters whose lower case is one letter; with a stop, of two pieces at least
WORD = "^[A-Za-zÀ-ÖØ-öø-į]+$"
WORD_OR_SIGNS = r"^([A-Za-zÀ-ÖØ-öø-į]+|[!-&(-/:-@\[-`{-~]+)$"  # either part of HEAD_TAIL
STOP = "^[A-Za-zÀ-ÖØ-öø-į]+[.,;:!?]$"
# such letters, then signs: all of ASCII but the apostrophe, that may begin a piece with letters
HEAD_TAIL = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-į]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
SPECIAL = r"^[A-Za-zÀ-ÖØ-öø-į]*[!-&(-/:-@\[-`{-~]*$"  # a string that might be found in the former
# pieces: some endings, letters, a digit, other signs (as in CLIP's tokenizer)
LETTERS_OR_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = 1 << 20  # characters of a text that are encoded at once
AT_ONCE = 4 << 20  # characters of texts that are encoded at once
PLACED = 1 << 17  # stretches, about, whose ids are put in place at once
BATCH = 1 << 20  # ids that go back to Spark in one batch
SENT = 256  # ids a row that go from Spark for their checksum
FILE_TEXT = 256 << 20  # bytes of text a file, about
LEAST_TEXT = 4 << 20  # bytes of text a file, if there are tasks to spare
INDEX_ROWS = 1_000_000  # files whose index rows (16 bytes each) are broadcast

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def spaces_part(tokenizer: Tokenizer) -> bool:
    """Whether text may be cut at ASCII white space without a change to its
    ids: steps that look at single characters or white space alone, pieces that
    never hold or cross white space, no special string with any."""
    state = json.loads(tokenizer.to_str())

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    def local(step: dict) -> bool:
        spaces = step.get("pattern", {}).get("Regex") == r"\s+" and step.get("content") == " "
        return step["type"] in ("NFC", "NFD", "Lowercase") or step["type"] == "Replace" and spaces

    model = state["model"]
    if not all(map(local, steps(state["normalizer"], "normalizers"))) or model["type"] != "BPE" or model.get("dropout"):
        return False
    if any(x["content"].split() != [x["content"]] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in state["added_tokens"]):
        return False
    kinds = steps(state["pre_tokenizer"], "pretokenizers")
    if not kinds or kinds[0]["type"] != "Split" or kinds[0]["behavior"] != "Removed":
        return False
    pieces = lambda text: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    marks = [chr(c) for c in range(33, 127)] + ["é", "ß", "中", "٣", "́", "‍"]
    alone = {m: pieces(m) for m in marks}
    return all(pieces(f"{a}{space}{b}") == alone[a] + alone[b] for a, b in product(marks, marks) for space in " \t\n\v\f\r")


def normalizers(state: dict) -> set[str]:
    """Kinds of the steps a text takes before it is cut."""
    first = state["normalizer"] or {"normalizers": []}
    return {step["type"] for step in first.get("normalizers", [first])}


def signs_part(tokenizer: Tokenizer) -> bool:
    """Whether letters and signs after them are always pieces of their own, given
    ``spaces_part``: the tokenizer's own cut is the known one, accents stay in
    their letters, and no special string is of letters, signs or both so."""
    state = json.loads(tokenizer.to_str())
    first = state["pre_tokenizer"].get("pretokenizers", [state["pre_tokenizer"]])[0]
    special = pa.array([x["content"] for x in state["added_tokens"]], pa.string())
    clear = not pc.any(pc.match_substring_regex(special, SPECIAL)).as_py()
    return first["pattern"].get("Regex") == LETTERS_OR_SIGNS and first["invert"] and "NFD" not in normalizers(state) and clear


def pieces(text: str) -> Iterator[str]:
    """A text cut before spaces, every ``PIECE`` characters or so; at least one piece."""
    at = 0
    while (end := text.find(" ", at + PIECE)) > 0:
        yield text[at:end]
        at = end
    yield text[at:]


def put(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at the places given, in order."""
    return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Encoder:
    """Ids of texts (int32)."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parted = spaces_part(self.tokenizer)
        self.signs_part, self.lowers = self.parted and signs_part(self.tokenizer), "Lowercase" in normalizers(json.loads(self.tokenizer.to_str()))
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.tokenizer.encode_special_tokens = special_as_text
        self._forget()

    def _forget(self) -> None:
        """What is known: strings, and where the ids of each begin in all ids."""
        self.known, self.begin, self.data = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, "<i4")

    def _of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str], pieces: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of each) of stretches of at least ``pieces`` pieces
        each: many as one text, cut at the ends of pieces.  If there are just
        so many, each stretch has its own."""
        for i in range(0, len(words), GROUP):
            group = words[i : i + GROUP]
            ids = self._of([" ".join(group)])[0]
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == pieces * len(group) and at[-1] == len(ids):
                yield ids, np.diff(at[pieces - 1 :: pieces], prepend=0)
            else:
                yield from self._alone(group)

    def _alone(self, stretches: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(stretches), GROUP):
            ids = self._of(stretches[i : i + GROUP])
            yield np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Where the new strings stand among the known ones from now on."""
        word, stop = pc.match_substring_regex(new, WORD_OR_SIGNS if self.signs_part else WORD), pc.match_substring_regex(new, STOP)
        kinds = [word, stop, pc.invert(pc.or_(word, stop))]
        words, stops, others = (new.filter(m).to_pylist() for m in kinds)
        ids, sizes = zip(*self._of_words(words, 1), *self._of_words(stops, 2), *self._alone(others))
        order = np.concatenate([np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in kinds])
        at = np.empty(len(new), np.int64)
        at[order] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes)))
        self.data = np.concatenate([self.data, *ids])
        return at

    def _places(self, strings: pa.Array) -> np.ndarray:
        """Where distinct strings stand among the known ones; new ones are learned."""
        found = pc.index_in(self.known, value_set=strings)  # hashes the fewer ones
        at = np.full(len(strings), -1)
        at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        if (new := at < 0).any():
            at[new] = self._learn(strings.filter(pa.array(new)))
        return at

    def _full(self) -> bool:
        return len(self.known) > REMEMBERED or (pc.sum(pc.binary_length(self.known)).as_py() or 0) + self.data.nbytes > KEPT

    def _spare(self, last: np.ndarray) -> None:
        """If too many are known, those at the places ``last`` stay, if they are not too many."""
        if self._full():
            size = self.begin[last + 1] - self.begin[last]
            self.known, self.data = self.known.take(pa.array(last)), put(self.data, self.begin[last], size)
            self.begin = np.append(0, np.cumsum(size))
            if self._full():
                self._forget()

    def _of_distinct(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of distinct stretches."""
        place = np.zeros((2, len(stretches), 2), np.int64)  # begin and number; of a word or another stretch, of signs after a word
        strings, parts = stretches, np.zeros(len(stretches), bool)
        if self.signs_part:
            split = pc.extract_regex(stretches, HEAD_TAIL)
            head, tail = split.drop_null().flatten()
            strings = pa.concat_arrays([pc.utf8_lower(head) if self.lowers else head, tail, stretches.filter(split.is_null())])
            parts = split.is_valid().to_numpy(zero_copy_only=False)
        strings = strings.dictionary_encode()
        last = self._places(strings.dictionary)
        at, n = last[strings.indices.to_numpy()], parts.sum()
        of = np.stack([self.begin[at], self.begin[at + 1] - self.begin[at]])
        place[:, parts, 0], place[:, parts, 1], place[:, ~parts, 0] = of[:, :n], of[:, n : 2 * n], of[:, 2 * n :]
        ids = put(self.data, *place.reshape(2, -1))
        self._spare(last)
        return ids, place[1].sum(1)

    def _of_pieces(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of all texts at once: every distinct stretch once, then put in place."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        stretches = split.flatten().dictionary_encode()
        ids, size = self._of_distinct(stretches.dictionary)
        begin = np.cumsum(size) - size
        index, ends = stretches.indices.to_numpy(), split.offsets.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ends[1:] // PLACED)) + 1).tolist(), len(texts)]
        for a, b in zip(edges[:-1], edges[1:]):
            at = index[ends[a] : ends[b]]
            after = np.append(0, np.cumsum(size[at]))
            yield from np.split(put(ids, begin[at], size[at]), after[ends[a + 1 : b] - ends[a]])
        pa.default_memory_pool().release_unused()  # else a worker goes on holding what it once needed

    def encoded(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        if not self.parted:
            yield from (self._of([text])[0] for text in texts)
            return
        held, chars, begun = [], 0, []

        def finished() -> Iterator[np.ndarray]:
            for ids, (_, last) in zip(self._of_pieces([p for p, _ in held]), held):
                begun.append(ids)
                if last:
                    yield np.concatenate(begun)
                    begun.clear()

        for text in texts:
            cut = list(pieces(text))
            for i, piece in enumerate(cut):
                held.append((piece, i == len(cut) - 1))
                chars += len(piece)
                if chars >= AT_ONCE:
                    yield from finished()
                    held, chars = [], 0
        if held:
            yield from finished()


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per Python worker."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, special_as_text)
    return _ENCODERS[path, special_as_text]


def _batch(schema: pa.Schema, ids: list, part: int, starts: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in lists], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    columns = [pa.array(ids, schema.field(0).type), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists)))]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def files_for(docs: DataFrame, text_col: str) -> int:
    """Files by the bytes of text, spread over the session's shuffle partitions
    as long as files stay over ``LEAST_TEXT``."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // FILE_TEXT), min(spread, size // LEAST_TEXT))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, page_rows: int = 512, special_as_text: bool = False) -> None:
    """Writes the ids of all texts under ``path`` (not there yet), each
    followed by ``end_id`` if one is given.  ``tokenizer``: a file that every
    executor has."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange(files or files_for(docs, text_col), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([] if end_id is None else [end_id], "<i4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, of = TaskContext.get().partitionId(), 0, encoder(tokenizer, special_as_text)
        for batch in batches:
            fields = [batch.schema.field(0), pa.field("file", pa.int32()), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32()))]
            schema, ids, starts, lists, held = pa.schema(fields), [], [], [], 0
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, found in zip(batch.column(0), of.encoded(texts)):
                ids.append(doc_id.as_py())
                starts.append(before)
                lists.append(np.append(found, end))
                before, held = before + len(lists[-1]), held + len(lists[-1])
                if held >= BATCH:
                    yield _batch(schema, ids, part, starts, lists)
                    ids, starts, lists, held = [], [], [], 0
            if ids:
                yield _batch(schema, ids, part, starts, lists)

    encoded = rows.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, file int, start bigint, n_tokens bigint, ids array<int>")
    layout = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 4 << 20, "compression": "zstd",
    }
    encoded.write.options(**layout).parquet(f"{path}/tokens")

    spark = docs.sparkSession
    sums = spark.read.parquet(f"{path}/tokens").groupBy("file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("bigint"))).coalesce(1).write.parquet(f"{path}/files")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, docs, n_tokens, first_id, last_id, base): a row per file."""
    return spark.read.parquet(f"{path}/files")


def _placed(spark: SparkSession, path: str, where: Column | None, columns: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/tokens")
    rows = rows.filter(where) if where is not None else rows
    base = small(index(spark, path).select("file", "base"), INDEX_ROWS)
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), *columns)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens): reads no ids."""
    return _placed(spark, path, None, ["n_tokens"])


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document."""
    return _placed(spark, path, None, ["n_tokens", "ids"])


def of_ids(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The documents named; only pages whose range of ids holds one are read."""
    return _placed(spark, path, F.col("doc_id").isin(ids), ["n_tokens", "ids"])


def of_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The documents that hold any of the positions ``begin`` to ``end`` - 1;
    only their files, and in the first and last of these their pages, are read."""
    over = index(spark, path).filter((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > begin))
    edge = over.agg(F.min(F.struct("file", "base")).alias("lo"), F.max(F.struct("file", "base")).alias("hi")).first()
    if begin >= end or edge["lo"] is None:
        return tokens(spark, path).limit(0)
    (first, lo), (last, hi) = edge["lo"], edge["hi"]
    where = F.col("file").between(first, last) & ((F.col("file") > first) | (F.col("start") + F.col("n_tokens") > begin - lo)) & ((F.col("file") < last) | (F.col("start") < end - hi))
    return _placed(spark, path, where, ["n_tokens", "ids"])


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``tokens``: n_tokens is
    the length of the list read, ids_crc32 the unsigned crc32 of its ids as
    little-endian unsigned 32-bit whole numbers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = size = 0
        for batch in batches:
            lists, last = batch.column(2), batch.column(3)
            at, values = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
            sizes, crcs = [], []
            for a, b, ended in zip(at[:-1].tolist(), at[1:].tolist(), last.to_pylist()):
                crc, size = zlib.crc32(values[4 * a : 4 * b], crc), size + b - a
                if ended:
                    sizes.append(size)
                    crcs.append(crc)
                    crc = size = 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(last), batch.column(1).filter(last), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a document's ids in rows of ``SENT``, one after the other: a batch of rows stays small however long the lists
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ids"), F.lit(1)), F.lit(SENT)))
    rows = rows.select("doc_id", "start", "ids", first.alias("first"))
    rows = rows.select("doc_id", "start", F.slice("ids", F.col("first"), F.lit(SENT)).alias("ids"), (F.col("first") + SENT > F.size("ids")).alias("last"))
    return rows.mapInArrow(digest, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
