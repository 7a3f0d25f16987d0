"""Token ids as flat binary files with 64-bit document offsets.

One pair of files per range of the key: ``.ids``, the ids one after another as
little-endian unsigned integers of 2 bytes (4 where the vocabulary needs them),
and ``.idx``, for each document its key and the place where its ids end, as
64-bit integers. Documents lie in ascending order of the key, files in the order of
the manifest; where each file begins among all ids is a prefix sum over the
files' totals. Both files are memory-mapped when read.

Defined results: a null or empty text has only the end id; rows that repeat a key
stay, ordered by a hash of their text; a null key comes first; an empty table
gives no files and no rows; other columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aislefix.llm import files, ordered
from aislefix.llm.cells import text_slices
from aislefix.llm.encoding import encoder
from aislefix.sources.tables import shared_folder

#: Stands for a null key in the index.
NO_KEY = np.iinfo(np.int64).min
END_ID = 1
_CHUNK = 4096


@dataclass(frozen=True)
class TokenFile:
    """``start`` counts the ids in all files before this one."""

    name: str
    dtype: str
    documents: int
    tokens: int
    start: int


def _writer(folder: str, path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = ids_file = index_file = None
        tokens = documents = number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coder = encoder(path)
            dtype = "<u2" if coder.vocabulary <= 1 << 16 else "<u4"
            if name is None:
                number = batch.column(2)[0].as_py()
                name = f"{folder}/{number:08d}-{uuid.uuid4().hex}"
                ids_file, index_file = files.open_new(f"{name}.ids"), files.open_new(f"{name}.idx")
            keys = batch.column(0).cast(pa.int64()).fill_null(int(NO_KEY)).to_numpy()
            for part in text_slices(batch.column(1)):
                ids, offsets = coder.encode(part, end_id)
                ids_file.write(ids.astype(dtype).tobytes())
                own = keys[part.first_row : part.first_row + part.rows]
                index_file.write(np.stack([own, offsets[1:] + tokens], axis=1).astype("<i8").tobytes())
                tokens += len(ids)
                documents += part.rows
        if name is not None:
            ids_file.close()
            index_file.close()
            row = {"number": [number], "name": [name], "dtype": [dtype], "documents": [documents], "tokens": [tokens]}
            yield pa.RecordBatch.from_pydict(row)

    return run


def write_token_files(
    df: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID
) -> list[TokenFile]:
    """Encode every text, write the files, and return the manifest: one entry a range, in order."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    docs = df.select(df[key].alias("k"), df[text].alias("t"))
    ranges = ordered.range_count(df)
    bounds = ordered.key_bounds(docs, "k", ranges)
    dealt = (
        docs.withColumn("r", ordered.range_of(F.col("k"), bounds))
        .repartitionById(ranges, F.col("r").cast("int"))
        .sortWithinPartitions("k", F.xxhash64("t"))
    )
    kinds = "number bigint, name string, dtype string, documents bigint, tokens bigint"
    rows = sorted(dealt.mapInArrow(_writer(folder, tokenizer, end_id), kinds).collect(), key=lambda r: r.number)
    manifest, start = [], 0
    for row in rows:
        manifest.append(TokenFile(row["name"], row["dtype"], row["documents"], row["tokens"], start))
        start += row["tokens"]
    return manifest


def read_token_files(spark: SparkSession, manifest: list[TokenFile], key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document of the files: its key, first place among all ids, length, checksum, and on request its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file = manifest[number]
                ids = files.mapped(f"{file.name}.ids", file.dtype)
                index = files.mapped(f"{file.name}.idx", "<i8").reshape(-1, 2)
                for first in range(0, len(index), _CHUNK):
                    rows = index[first : first + _CHUNK]
                    ends = rows[:, 1].astype(np.int64)
                    starts = np.concatenate([[index[first - 1, 1] if first else 0], ends[:-1]])
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    arrays = [
                        pa.array(rows[:, 0].astype(np.int64), mask=rows[:, 0] == NO_KEY), pa.array(starts + file.start),
                        pa.array(ends - starts), pa.array(sums, pa.int64()),
                    ]
                    names = [key, "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        places = pa.array(np.append(starts, ends[-1]) - starts[0], pa.int32())
                        arrays.append(pa.ListArray.from_arrays(places, pa.array(ids[starts[0] : ends[-1]].astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(run, schema)
