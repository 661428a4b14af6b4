"""CSV files with line breaks inside quotes, read in as many pieces as the files have splits.

Spark cuts text files at line ends, wherever quotes stand. Whether a line begins inside quotes depends on all
lines before it, so it is found in two passes:

1. Each split works out how it ends if it begins outside of quotes and if it begins inside, for a line is a map
   between these two states, and so are lines one after another. These maps, one per split, are put together in
   file order on the driver: then it is known how each split begins.
2. Each split cuts its lines into records. Where a record goes on into the next splits, its parts
   meet in a shuffle, which nothing else does.

Records are parsed by ``from_csv``. A quote opens a quoted value only where a value begins, two quotes
in it stand for one, and what follows a closing quote belongs to the value up to the next
separator, as for Spark's own reader. Line breaks inside quotes stay as they are in the file. Blank records are passed over, and each file's first record is its header; files must share
one. A line must fit into memory, a file need not. Compressed files are one split. Both passes must see the same splits: where the
number of executors changes meanwhile, set spark.sql.files.minPartitionNum, else a changed split is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT, IN = 0, 1
_QUOTED = r'"(?:[^"]|"")*+'
_VALUE = rf'(?:{_QUOTED}"[^,]*+|(?!")[^,]*+)'
#: A line that begins outside of quotes and ends inside; the end of a quoted value, and what may follow up to the next one.
_OPENS = re.compile(rf"(?:{_VALUE},)*+{_QUOTED}\Z").match
_CLOSES = re.compile(r'(?:[^"]|"")*+"[^,]*+(?:,|\Z)').match


def ends(line: str) -> tuple[int, int]:
    """The state after a line that begins outside, and inside of quotes."""
    closed = _CLOSES(line)
    inside = IN
    if closed:
        # after the last separator a new value begins, even an empty one
        rest = line[closed.end() :]
        inside = IN if rest and _OPENS(rest) else OUT
    return (IN if _OPENS(line) else OUT), inside


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and file and start of the split it comes from, in file order within each split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Lines of one split after another."""
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1
    for at, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if stop > at:
            yield (file.dictionary[int(code[at])].as_py(), int(start[at])), batch.column("value").slice(at, stop - at)


def _with_quotes(values: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist()


def split_maps(rows: DataFrame) -> list:
    """file, start, out and inside: how each split ends if it begins outside and inside of quotes."""

    def run(batches):
        found: dict[tuple[str, int], tuple[int, int]] = {}
        for batch in batches:
            for split, values in _runs(batch):
                state = found.get(split, (OUT, IN))
                for i in _with_quotes(values):
                    own = ends(values[i].as_py())
                    state = own[state[0]], own[state[1]]
                found[split] = state
        columns = list(zip(*[(*split, *state) for split, state in found.items()])) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "out", "inside"])

    return rows.mapInArrow(run, "file string, start long, out int, inside int").collect()  # a row for each split


def first_states(maps: list) -> dict[tuple[str, int], int]:
    """How each split begins."""
    begins, state, file = {}, OUT, None
    for row in sorted(maps, key=lambda r: (r.file, r.start)):
        state = OUT if row.file != file else state
        file, begins[row.file, row.start] = row.file, state
        state = row.inside if state == IN else row.out
    return begins


NAMES = ["record", "file", "start", "part", "first"]
WHOLE, TAIL, HEAD = 0, 1, 2  # a whole record; the rest of one that began in a split before; the beginning of one that goes on


def records(spark: SparkSession, path: str) -> DataFrame:
    """record, file, start and first: the text of each record, and whether it is the first of its file."""
    rows = lines(spark, path)
    begins = spark.sparkContext.broadcast(first_states(split_maps(rows)))

    def run(batches):
        split, state, open_lines, part, first = None, OUT, [], WHOLE, False
        out: list[tuple[str, str, int, int, bool]] = []

        def flush(kind: int) -> None:
            nonlocal open_lines, first
            out.append(("\n".join(open_lines), *split, kind, first))
            open_lines, first = [], False

        def emitted():
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

        for batch in batches:
            for own, values in _runs(batch):
                if own != split:
                    if open_lines:
                        flush(HEAD if part == WHOLE else TAIL)
                    if own not in begins.value:
                        raise ValueError("files were split anew between two passes: set spark.sql.files.minPartitionNum")
                    split, state = own, begins.value[own]
                    part, first = (WHOLE if state == OUT else TAIL), own[1] == 0 and state == OUT
                quoted = set(_with_quotes(values))
                for i, line in enumerate(values.to_pylist()):
                    open_lines.append(line)
                    if i in quoted:
                        state = ends(line)[state]
                    if state == OUT:
                        flush(part)
                        part = WHOLE
            yield emitted()
        if open_lines:
            flush(HEAD if part == WHOLE else TAIL)
        yield emitted()

    parts = rows.mapInArrow(run, "record string, file string, start long, part int, first boolean")
    cut = parts.where(F.col("part") != WHOLE)
    # a record's parts are the beginning and all rests up to the next beginning
    sets = cut.select("file", "start", "part").groupBy("file").agg(F.sort_array(F.collect_set(F.struct("start", "part"))).alias("all"))
    heads = F.filter("all", lambda x: x["part"] == HEAD)
    before = F.filter(heads, lambda x: x["start"] < F.col("start"))
    owner = F.when(F.col("part") == HEAD, F.col("start")).otherwise(F.element_at(before, -1)["start"])
    owned = cut.join(sets, "file").select("file", owner.alias("owner"), "start", "record", "first")
    joined = owned.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "record", "first"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["record"]), "\n")
    joined = joined.select(text.alias("record"), "file", F.col("owner").alias("start"), F.col("parts")[0]["first"].alias("first"))
    return parts.where(F.col("part") == WHOLE).select("record", "file", "start", "first").union(joined)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header, all columns as text, as by ``spark.read.csv(..., multiLine=True)``."""
    options = {"quote": '"', "escape": '"'}
    columns = spark.read.csv(path, header=True, multiLine=True, **options).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    found = records(spark, path).where(~F.col("first") & (F.trim("record") != "") & (F.col("record") != "\r"))
    text = F.regexp_replace("record", "\r$", "")
    return found.select(F.from_csv(text, schema, options).alias("r")).select("r.*")

