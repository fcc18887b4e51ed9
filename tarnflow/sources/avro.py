"""Avro container files as a Python data source, for sessions without Spark's Avro package.

Covers null, boolean, int, long, float, double, bytes, string, enum, fixed, array, map, record and unions with
null; codecs null and deflate. Files are read and written by Spark, on any file system that it reaches.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.transforms import arrow_schema

_MAGIC = b"Obj\x01"
_SYNC = 16
_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


def _long(f) -> int:
    shift = value = 0
    while True:
        byte = f.read(1)
        if not byte:
            raise EOFError
        value |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _put_long(n: int) -> bytes:
    z = (n << 1) ^ (n >> 63)
    out = bytearray()
    while z & ~0x7F:
        out.append((z & 0x7F) | 0x80)
        z >>= 7
    out.append(z)
    return bytes(out)


def _blocks(f, one):
    while n := _long(f):
        if n < 0:
            _long(f)
            n = -n
        for _ in range(n):
            one()


def decode(f, schema):
    if isinstance(schema, list):
        return decode(f, schema[_long(f)])
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        return _long(f)
    if kind == "float":
        return struct.unpack("<f", f.read(4))[0]
    if kind == "double":
        return struct.unpack("<d", f.read(8))[0]
    if kind == "bytes":
        return f.read(_long(f))
    if kind == "string":
        return f.read(_long(f)).decode()
    if kind == "fixed":
        return f.read(schema["size"])
    if kind == "enum":
        return schema["symbols"][_long(f)]
    if kind == "array":
        out: list = []
        _blocks(f, lambda: out.append(decode(f, schema["items"])))
        return out
    if kind == "map":
        named: dict = {}

        def entry():
            key = decode(f, "string")
            named[key] = decode(f, schema["values"])

        _blocks(f, entry)
        return named
    if kind == "record":
        return {x["name"]: decode(f, x["type"]) for x in schema["fields"]}
    return decode(f, kind)


def encode(value, schema) -> bytes:
    if isinstance(schema, list):
        at = schema.index("null") if value is None else next(k for k, s in enumerate(schema) if s != "null")
        return _put_long(at) + encode(value, schema[at])
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind in ("int", "long"):
        return _put_long(int(value))
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "double":
        return struct.pack("<d", value)
    if kind == "bytes":
        return _put_long(len(value)) + bytes(value)
    if kind == "string":
        data = value.encode()
        return _put_long(len(data)) + data
    if kind == "array":
        values = list(value)
        return (_put_long(len(values)) + b"".join(encode(x, schema["items"]) for x in values) if values else b"") + b"\x00"
    if kind == "map":
        pairs = list(value.items())
        return (_put_long(len(pairs)) + b"".join(encode(k, "string") + encode(x, schema["values"]) for k, x in pairs) if pairs else b"") + b"\x00"
    if kind == "record":
        return b"".join(encode(value[x["name"]], x["type"]) for x in schema["fields"])
    return encode(value, kind)


def spark_type(schema) -> T.DataType:
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1:
            raise ValueError(f"union of several types: {schema}")
        return spark_type(rest[0])
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    if kind in _PLAIN:
        return _PLAIN[kind]
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if kind == "record":
        return T.StructType([T.StructField(x["name"], spark_type(x["type"])) for x in schema["fields"]])
    raise ValueError(f"type {kind}")


def avro_type(kind: T.DataType, name: str = "row"):
    for plain, t in _PLAIN.items():
        if kind == t:
            return plain
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return "int"
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", avro_type(kind.elementType, name + "_item")]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", avro_type(kind.valueType, name + "_value")]}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_type(f.dataType, f"{name}_{f.name}")]} for f in kind]}
    raise ValueError(f"no Avro type for {kind}")


def _header(f) -> tuple[object, str, bytes]:
    if f.read(4) != _MAGIC:
        raise ValueError("not an Avro container file")
    meta = decode(f, {"type": "map", "values": "bytes"})
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(_SYNC)


def _unpacked(block: bytes, codec: str) -> bytes:
    if codec == "deflate":
        return zlib.decompress(block, -15)
    if codec != "null":
        raise ValueError(f"codec {codec}")
    return block


def records(data: bytes) -> Iterator[dict]:
    """Records of the bytes of one or more container files, one after another."""
    f = io.BytesIO(data)
    while f.tell() < len(data):
        schema, codec, sync = _header(f)
        while f.tell() < len(data) and data[f.tell() : f.tell() + len(_MAGIC)] != _MAGIC:
            count, size = _long(f), _long(f)
            inner = io.BytesIO(_unpacked(f.read(size), codec))
            if f.read(_SYNC) != sync:
                raise ValueError("a block doesn't end in the file's marker")
            for _ in range(count):
                yield decode(inner, schema)


def _block_records(data: bytes, schema, codec: str) -> Iterator[dict]:
    """Records of one block without the marker that ends it."""
    f = io.BytesIO(data)
    count, size = _long(f), _long(f)
    block = f.read(size)
    if len(block) != size or f.read(1):
        raise ValueError("a block doesn't end in the file's marker")
    inner = io.BytesIO(_unpacked(block, codec))
    for _ in range(count):
        yield decode(inner, schema)


def _first_header(spark: SparkSession, path: str) -> tuple[object, str, bytes]:
    """Schema, codec and marker of the first file at ``path``, of which the driver reads the header only."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path").orderBy("path").limit(1).collect()
    if not files:
        raise ValueError(f"no Avro files at {path}")
    file = spark._jvm.org.apache.hadoop.fs.Path(files[0].path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    size, whole = 1 << 16, fs.getFileStatus(file).getLen()
    while True:
        stream = fs.open(file)
        try:
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, whole)))
        finally:
            stream.close()
        f = io.BytesIO(data)
        try:
            found = _header(f)
        except (EOFError, IndexError, ValueError):
            if size >= whole:
                raise
            found = None
        if found and len(found[2]) == _SYNC:
            return found
        if size >= whole:
            raise ValueError(f"{files[0].path} ends within its header")
        size *= 4


def read(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """Records of all files at ``path``; the first file's schema holds for all.

    The marker of the first file separates blocks as a line end separates lines, so large files are split between tasks
    by Spark's text reader. A file with another marker comes as one piece, and is read by its own header.
    """
    schema, codec, sync = _first_header(spark, path)
    kind = spark_type(schema)
    out_schema = arrow_schema(kind)
    parts = spark.read.option("lineSep", sync.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in batches:
            out: list[dict] = []
            for data in pieces.column(0):
                data = data.as_py()
                if data.startswith(_MAGIC):
                    rows = () if _header(io.BytesIO(data + sync))[2] == sync else records(data)
                else:
                    rows = _block_records(data, schema, codec)
                for row in rows:
                    out.append(row)
                    if len(out) == batch:
                        yield pa.RecordBatch.from_pylist(out, out_schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, out_schema)

    return parts.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, kind)


def _head(schema) -> bytes:
    """What a file begins with, without its marker."""
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"deflate"}
    return _MAGIC + encode(meta, {"type": "map", "values": "bytes"})


def _packed(rows: list[dict], schema) -> bytes:
    """A block, without the marker that ends it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(b"".join(encode(r, schema) for r in rows)) + packer.flush()
    return _put_long(len(rows)) + _put_long(len(data)) + data


def container(rows: list[dict], schema, block: int = 1000) -> bytes:
    """The bytes of one file of rows in memory."""
    sync = uuid.uuid4().bytes
    return b"".join(part + sync for part in (_head(schema), *(_packed(rows[at : at + block], schema) for at in range(0, len(rows), block))))


def write(df: DataFrame, path: str, append: bool = False, block: int = 1000) -> None:
    """A container file per partition, by Spark's text writer: any file system and its commit protocol, a block in memory at a time.

    A block ends in the marker of its file, which is written as text ends its lines.
    """
    schema = avro_type(df.schema)
    sync = uuid.uuid4().hex[:_SYNC]
    header = _head(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header], pa.binary())], ["value"])
        for rows in batches:
            for at in range(0, rows.num_rows, block):
                own = rows.slice(at, block).to_pylist(maps_as_pydicts="strict")
                yield pa.RecordBatch.from_arrays([pa.array([_packed(own, schema)], pa.binary())], ["value"])

    text = df.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.mode("append" if append else "errorifexists").options(lineSep=sync, compression="none", maxRecordsPerFile=0).text(path)
