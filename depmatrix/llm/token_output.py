"""Token ids of all documents as binary files in ascending order of doc_id, in Simple-8b words, and the documents read back from the files.

Documents are divided by ranges of doc_id and sorted in their tasks; each task tokenises its documents, one after the other, and closes a file when it has FILE_IDS ids, so that
a file's size is bounded by that and one document. Files are rows of a table (a part's number, its place in the part, the bytes), which goes to the folder that the
cluster shares; to_files() and from_files() are for a mounted folder. A file knows how many ids its part has before it; one sum for each part gives the rest.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.llm import simple8b
from depmatrix.llm.shared import written

END = 2
FILE_IDS = 1 << 18
_FILES = "part int, seq int, first long, n_ids long, image binary"
#: White space by any table of it, and marks without width.
_WHITE = frozenset(c for c in map(chr, [*range(0x3001), 0xFEFF]) if c.isspace() or c in "\u180e\ufeff" or "\u200b" <= c <= "\u200f" or "\u2028" <= c <= "\u202f" or "\u2060" <= c <= "\u2064")
#: A space after anything else: the tokenizer's pattern always begins a piece there, so what stands between is tokenised alike by itself.
_CUT = re.compile(f"(?<![{re.escape(''.join(sorted(_WHITE)))}]) ")
#: So it does before these marks after an ASCII letter or digit; for long stretches without a space.
_LONG_CUT = re.compile("(?<=[A-Za-z0-9])(?=[\\n!-/:-@\\[-`{-~\\u3001\\u3002\\uff01\\uff0c\\uff1b\\uff1f])")
_LONG, _WINDOW, _REMEMBERED = 1 << 14, 1 << 18, 1_000_000
#: Bytes of texts whose stretches are looked up together, and stretches that the tokenizer gets as one text.
_TOGETHER, _JOINED = 1 << 23, 256


#: Marks that are a token's piece of their own behind an ASCII letter or digit, where nothing follows them.
_MARKS = frozenset(",.;:!?)")


class Tokens:
    """Ids of texts, by a tokenizer. Texts are cut at spaces between which no token runs; what stands between two is remembered (_REMEMBERED and what _TOGETHER bytes hold twice at
    most, some 250 MB; of two halves the older goes, but for what was met again). Some _WINDOW characters of a text are worked on at a time; only a stretch of letters alone, or of marks
    alone, is tokenised in one piece whatever its length."""

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._letters = None  # the same model for ASCII letters behind a space, which are a piece each: no pattern, and their bytes are their own letters
        cut, added = self._tokenizer.pre_tokenizer, [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        if isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and self._tokenizer.normalizer is None:
            if not any(re.fullmatch("[A-Za-z ]*", x) for x in added):
                self._letters = Tokenizer(self._tokenizer.model)
                self._letters.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self._met: dict[str, bytes] = {}  # ids of what follows a space
        self._older: dict[str, bytes] = {}
        self._after_line: dict[str, bytes] = {}  # and a newline, that included
        self._mark = {x: self._encode([x])[0] for x in _MARKS}
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._begun = {}  # by what stands in front, a space or a newline: which ids begin with it
        for lead, letter in ((" ", "\u0120"), ("\n", "\u010a")):  # as the alphabet of bytes has them
            self._begun[lead] = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self._begun[lead][[i for x, i in vocabulary.items() if x[:1] == letter]] = True

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _behind(self, lead: str, stretches: list[str]) -> dict[str, bytes]:
        """Ids of different stretches of at most _LONG characters, each with lead in front. Those without lead inside or white space at the end go to the tokenizer many at a time,
        as a text: there each lead is a cut, so an id that begins with one begins a stretch. Where the count of these isn't that of the stretches, they are asked for singly."""
        plain = [x for x in stretches if x and lead not in x and x[-1] not in _WHITE]
        got: dict[str, bytes] = {}
        kinds = [(self._tokenizer, "", lead, plain)]
        if self._letters and lead == " ":
            letters = [x for x in plain if x.isascii() and x.isalpha()]
            kinds = [(self._letters, " ", "\u0120", letters), (self._tokenizer, "", lead, [x for x in plain if not (x.isascii() and x.isalpha())])]
        for tokenizer, between, front, asked in kinds:
            groups = [asked[i : i + _JOINED] for i in range(0, len(asked), _JOINED)]
            for group, e in zip(groups, tokenizer.encode_batch_fast([front + (between + front).join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at = (np.flatnonzero(self._begun[lead][ids]) * 4).tolist()
                if len(at) == len(group) and at[0] == 0:
                    raw = ids.tobytes()
                    got.update(zip(group, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], strict=True))
        if len(got) < len(stretches):
            left = [x for x in stretches if x not in got]
            got.update(zip(left, self._encode([lead + x for x in left]), strict=True))
        return got

    def _whole(self, stretch: str) -> bytes:
        return b"".join(self._encode([stretch] if len(stretch) <= _LONG else _LONG_CUT.split(stretch)))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of stretches not met before. A newline between two words, and a mark at the end, begin pieces, so that words are asked for once, whatever stands beside them."""
        lined = {x: x.split("\n") for x in new if "\n" in x}
        lined = {x: y for x, y in lined.items() if all(w and w[0] not in _WHITE and w[-1] not in _WHITE for w in y)}
        after = [w for w in {w for y in lined.values() for w in y[1:]} if w not in self._after_line]
        self._after_line.update(self._behind("\n", [x for x in after if len(x) < _LONG]))
        self._after_line.update((x, self._whole("\n" + x)) for x in after if len(x) >= _LONG)
        asked = dict.fromkeys(x for x in new if x not in lined)  # dicts for sets, in the order of the texts, which is that of memory
        asked.update((y[0], None) for y in lined.values() if self._recall(y[0]) is None)
        marked = {x: x[:-1] for x in asked if len(x) > 1 and x[-1] in _MARKS and x[-2].isascii() and x[-2].isalnum()}
        plain = dict.fromkeys(x for x in asked if x not in marked) if marked else asked
        plain.update((x, None) for x in marked.values() if x not in plain and self._recall(x) is None)
        long = [x for x in plain if len(x) > _LONG]
        got = self._behind(" ", [x for x in plain if len(x) <= _LONG])
        got.update((x, self._whole(" " + x)) for x in long)
        for x, word in marked.items():
            got[x] = (got[word] if word in got else self._met[word]) + self._mark[x[-1]]
        for x, y in lined.items():
            got[x] = (got[y[0]] if y[0] in got else self._met[y[0]]) + b"".join([self._after_line[w] for w in y[1:]])
        passing = {x for x in got if not x or x[-1] in _WHITE or len(x) > 256}
        self._met.update({x: ids for x, ids in got.items() if x not in passing} if passing else got)
        return got

    def _recall(self, stretch: str) -> bytes | None:
        ids = self._met.get(stretch)
        if ids is None and (ids := self._older.get(stretch)) is not None:
            self._met[stretch] = ids
        return ids

    def _recall_all(self, stretches: list[str]) -> list[bytes | None]:
        known = list(map(self._met.get, stretches))
        if self._older:
            unknown = [k for k, ids in enumerate(known) if ids is None]
            again = {k: ids for k, ids in zip(unknown, map(self._older.get, [stretches[k] for k in unknown]), strict=True) if ids is not None}
            self._met.update((stretches[k], ids) for k, ids in again.items())
            for k, ids in again.items():
                known[k] = ids
        return known

    def _forget(self) -> None:
        if 2 * (len(self._met) + len(self._after_line)) > _REMEMBERED:
            self._older, self._met = self._met, {}
            self._after_line.clear()

    def many(self, texts: pa.Array, end: int | None = END) -> Iterator[np.ndarray]:
        """ids() of each text, null as empty, in order. Each stretch of some _TOGETHER bytes of texts is looked up once; texts with white space in front of a space or
        at an end, and those above _WINDOW bytes, go through ids() by themselves."""
        texts = texts.fill_null("")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        before = np.append(0, np.cumsum(np.where(size > _WINDOW, 0, size)))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(before, before[at] + _TOGETHER, side="right")) - 1)
            yield from self._together(texts[at:stop], size[at:stop] > _WINDOW, end)
            at = stop

    def _together(self, texts: pa.Array, alone: np.ndarray, end: int | None) -> Iterator[np.ndarray]:
        self._forget()
        parts = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        edges, found = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        codes, stretches = found.indices.to_numpy().copy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        n = len(stretches)
        first, which = np.unique(codes[edges[:-1]], return_inverse=True)  # what begins a text has no space before it
        codes[edges[:-1]] = n + which
        used = np.zeros(n + len(first), bool)
        used[codes] = True
        used = used.tolist()
        known = self._recall_all(stretches)
        unknown = [k for k, ids in enumerate(known) if ids is None]
        odd = {k for k in unknown if not stretches[k] or stretches[k][-1] in _WHITE}
        new = [stretches[k] for k in unknown if k not in odd and used[k]]
        learnt = self._learn(new) if new else {}
        for k in unknown:
            known[k] = learnt[stretches[k]] if used[k] and k not in odd else b""
        begin = ["" if k in odd else stretches[k] for k in first.tolist()]
        known += [self._whole(x) if len(x) > _LONG else ids for x, ids in zip(begin, self._encode([x if len(x) <= _LONG else "" for x in begin]), strict=True)]
        apart = np.zeros(len(known), bool)
        apart[list(odd)] = True
        apart[n:] = apart[first]
        flat = np.frombuffer(b"".join(known), np.uint32)
        length = np.fromiter(map(len, known), np.int32, len(known)) // 4
        place = np.cumsum(length, dtype=np.int32) - length
        took = length[codes]
        until = np.cumsum(took, dtype=np.int32)
        out = flat[np.repeat(place[codes] - (until - took), took) + np.arange(until[-1], dtype=np.int32)]
        stops = until[edges[1:] - 1].tolist()
        alone = alone | np.logical_or.reduceat(apart[codes], edges[:-1])
        last = np.array([] if end is None else [end], np.uint32)
        for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
            yield self.ids(texts[k].as_py(), end) if alone[k] else np.concatenate([out[a:b], last])

    def ids(self, text: str, end: int | None = END) -> np.ndarray:
        out, at, n = [], 0, len(text)
        while at < n:
            found = _CUT.search(text, at + _WINDOW)
            stop = found.start() if found else n
            self._forget()
            part, first = text[at:stop], not at
            at = stop + 1  # the space belongs to what follows it
            last = [""] if at == n and found else []
            # what is remembered ends with no white space, so that a space behind it is a cut; what isn't is looked at
            stretches = part.split(" ")
            known = self._recall_all(stretches)
            new = [x for x, ids in zip(stretches, known, strict=True) if ids is None]
            if any(not x or x[-1] in _WHITE for x in new):
                stretches = _CUT.split(part) + last
                known = self._recall_all(stretches)
                new = [x for x, ids in zip(stretches, known, strict=True) if ids is None]
            elif last:
                stretches, known, new = stretches + last, [*known, None], [*new, ""]
            if first:
                known[0] = self._whole(stretches[0])
                new = [x for x, ids in zip(stretches, known, strict=True) if ids is None]
            if new:
                learnt = self._learn(new)
                known = [learnt[x] if ids is None else ids for x, ids in zip(stretches, known, strict=True)]
            out.append(b"".join(known))
        if end is not None:
            out.append(array("I", [end]).tobytes())
        return np.frombuffer(b"".join(out), np.uint32)


@functools.cache
def _tokens(path: str, special_as_text: bool) -> Tokens:
    """One for each worker process, which goes through many tasks."""
    return Tokens(path, special_as_text)


def token_files(docs: DataFrame, tokenizer: str, end: int | None = END, special_as_text: bool = True, file_ids: int = FILE_IDS) -> DataFrame:
    """(part, seq, first, n_ids, image): files of ids in ascending order of doc_id, by (part, seq). Null ids come first; a null text is an empty one.

    tokenizer: path of the tokenizer's file, the same on all workers. special_as_text: the names of special tokens in a text are text. end: appended to each document.
    Rows with the same id stand in the order of their texts' hashes; repeated rows are documents each. Empty table: no files. Other columns are not looked at."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    ranged = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq, first = _tokens(tokenizer, special_as_text), TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, first, held
            ids = np.concatenate(parts)
            raw = simple8b.image(names, np.cumsum([len(x) for x in parts]), ids, first)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64())]
            seq, first, held = seq + 1, first + len(ids), 0
            names.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([*row, pa.array([raw], pa.binary())], ["part", "seq", "first", "n_ids", "image"])

        for batch in batches:
            for name, got in zip(batch.column(0).to_pylist(), tokens.many(batch.column(1), end), strict=True):
                names.append(name)
                parts.append(got)
                held += len(got)
                if held >= file_ids:
                    yield close()
        if names:
            yield close()

    return written(ranged.mapInArrow(run, _FILES))


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files; start counts the ids of all documents before it, ids_crc32 is that of the ids as
    little-endian 32-bit integers. A damaged file is an error."""
    totals = files.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"))  # as many rows as tasks wrote
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.join(F.broadcast(totals.select("part", before.alias("before"))), "part").select("before", "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = simple8b.parse(raw.as_py())
                ids = found.ids()
                begins = np.append(0, found.ends[:-1])
                spans = [ids[a:b] for a, b in zip(begins.tolist(), found.ends.tolist(), strict=True)]
                columns = [
                    pa.array(found.doc_ids, pa.int64()),
                    pa.array(begins + (start + found.first), pa.int64()),
                    pa.array(found.ends - begins, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in spans], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return placed.mapInArrow(run, schema)


def to_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each file into a folder that all executors have mounted; (name, n_ids). A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for part, seq, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                name = f"ids-{part:06d}-{seq:06d}.s8b"
                with open(f"{folder}/.{name}.{os.getpid()}", "wb") as f:
                    f.write(raw.as_py())
                os.replace(f.name, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n_ids"])

    return files.select("part", "seq", "n_ids", "image").mapInArrow(run, "name string, n_ids long")


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The table of files that to_files() wrote, by Spark's reader of binary files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    number = lambda k: F.regexp_extract("path", r"ids-(\d+)-(\d+)\.s8b$", k).cast("int")
    count = lambda at: F.conv(F.hex(F.reverse(F.substring("content", at, 8))), 16, 10).cast("long")
    return raw.select(number(1).alias("part"), number(2).alias("seq"), count(21).alias("first"), count(13).alias("n_ids"), F.col("content").alias("image"))
