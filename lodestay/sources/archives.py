"""Sources inside archives: tables of zipped timetables, zipped map files, and map extracts in the PBF format.

Spark lists and reads the files, wherever they lie. Members of a zip are unpacked as streams, a few thousand rows at
a time; blocks of an extract are told apart in one pass and unpacked and decoded by as many tasks as there is room for.
"""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.functions.geo import METRES_A_DEGREE

_ROWS = 8192


def zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """``columns`` of the CSV files named ``member`` in the zip files at ``path``, as text, whatever order the file has them in.

    A file without the member has no rows; a column that it lacks, and a field that is empty, is null. One task reads
    one zip file; only the columns that are asked for leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in columns])
        for batch in batches:
            for content in batch.column(0):
                archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                if member not in archive.namelist():
                    continue
                with archive.open(member) as raw:
                    held: list[list] = []
                    for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline="")):
                        held.append([row.get(c) or None for c in columns])
                        if len(held) == _ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def zipped_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring) of the placemarks of the KML files in KMZ files at ``path``, ring array<struct<lat, lon>> of three points or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for content in frame["content"]:
                archive = zipfile.ZipFile(io.BytesIO(content))
                texts += [archive.read(n).decode("utf-8-sig") for n in archive.namelist() if n.lower().endswith(".kml")]
            yield pd.DataFrame({"text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.kmz").load(path).select("content")
    text = files.mapInPandas(run, "text string")
    marks = text.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))).alias("mark"))
    inside = lambda tag: F.regexp_extract("mark", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    bare = F.trim(F.regexp_replace(inside("name"), r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    words = F.filter(F.split(F.trim(inside("coordinates")), r"\s+"), lambda w: F.contains(w, F.lit(",")))
    pairs = F.transform(words, lambda w: F.struct(F.split(w, ",")[1].cast("double").alias("lat"), F.split(w, ",")[0].cast("double").alias("lon")))
    return marks.select(bare.alias("name"), pairs.alias("ring")).where(F.size("ring") >= 3)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: an int, or the bytes of a field with a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _numbers(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value >> 1 ^ -(value & 1) if signed else value)
    return out


def _summed(data: bytes) -> list[int]:
    out, total = [], 0
    for step in _numbers(data, signed=True):
        total += step
        out.append(total)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blobs of whole extracts, still packed."""
    for batch in batches:
        for content in batch.column(0):
            data, at = content.as_py(), 0
            while at < len(data):
                (size,) = struct.unpack_from(">I", data, at)
                head = dict(_fields(data[at + 4 : at + 4 + size]))
                at += 4 + size
                if head[1] == b"OSMData":
                    yield pa.RecordBatch.from_arrays([pa.array([data[at : at + head[3]]], pa.binary())], ["blob"])
                at += head[3]


_ELEMENTS = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64()))])


def _decoded(blob: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, tags, refs) of the nodes and ways of a blob; relations are left out."""
    parts = dict(_fields(blob))
    block: dict[int, list] = {}
    for number, value in _fields(parts[1] if 1 in parts else zlib.decompress(parts[3])):
        block.setdefault(number, []).append(value)
    words = [w.decode("utf-8", "replace") for _, w in _fields(block[1][0])]
    grain, lat0, lon0 = (block.get(n, [d])[0] for n, d in ((17, 100), (19, 0), (20, 0)))
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    degrees = lambda start, n: 1e-9 * (signed(start) + grain * n)
    for group in block.get(2, []):
        for number, value in _fields(group):
            if number not in (1, 2, 3):
                continue
            own = dict(_fields(value))
            if number == 2:  # all nodes of a group as columns of differences; tags of one after those of another
                keys, at = _numbers(own.get(10, b"")), 0
                for i, lat, lon in zip(_summed(own.get(1, b"")), _summed(own.get(8, b"")), _summed(own.get(9, b"")), strict=True):
                    tags = []
                    while at < len(keys) and keys[at]:
                        tags.append((words[keys[at]], words[keys[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, degrees(lat0, lat), degrees(lon0, lon), tags, []
                continue
            tags = [(words[k], words[v]) for k, v in zip(_numbers(own.get(2, b"")), _numbers(own.get(3, b"")), strict=True)]
            if number == 1:
                i, lat, lon = (n >> 1 ^ -(n & 1) for n in (own[1], own[8], own[9]))
                yield "node", i, degrees(lat0, lat), degrees(lon0, lon), tags, []
            else:
                yield "way", own[1], None, None, tags, _summed(own.get(8, b""))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            held = []
            for row in _decoded(blob.as_py()):
                held.append(row)
                if len(held) == _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _ELEMENTS, strict=True)], schema=_ELEMENTS)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _ELEMENTS, strict=True)], schema=_ELEMENTS)


def map_elements(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(kind, id, lat, lon, tags, refs) of the nodes and ways of the ``.osm.pbf`` files at ``path``.

    A file is read by one task, which only tells its blobs apart; they are dealt to ``tasks`` tasks (the session's number of
    shuffle partitions) that unpack and decode them. Nodes have a point and no refs, ways refs and no point.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.osm.pbf").load(path).select("content")
    blobs = files.mapInArrow(_blocks, "blob binary").repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blobs.mapInArrow(_elements, "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>")


def way_boxes(elements: DataFrame, wanted: Column) -> DataFrame:
    """(id, tags, lat, lon, metres) of the ways for which ``wanted`` holds: the mean of their vertices, and their longest side.

    A closed way names its first node again at the end, which counts once. Vertices that the extract lacks are left
    out; a way without any has no row.
    """
    ways = elements.where((F.col("kind") == "way") & wanted)
    closed = (F.size("refs") > 1) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1))
    corners = ways.withColumn("refs", F.when(closed, F.slice("refs", F.lit(1), F.size("refs") - 1)).otherwise(F.col("refs")))
    corners = corners.select("id", "tags", F.posexplode("refs").alias("_corner", "_node"))
    nodes = elements.where("kind = 'node'").select(F.col("id").alias("_node"), "lat", "lon")
    met = corners.join(nodes, "_node")
    # A map is no key of a group, so tags are taken from any corner.
    found = met.groupBy("id").agg(F.any_value("tags").alias("tags"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), (F.max("lat") - F.min("lat")).alias("_h"), (F.max("lon") - F.min("lon")).alias("_w"))
    side = F.greatest(F.col("_h") * METRES_A_DEGREE, F.col("_w") * METRES_A_DEGREE * F.cos(F.radians("lat")))
    return found.select("id", "tags", "lat", "lon", side.alias("metres"))


def _inside(box: tuple[float, float, float, float]) -> Column:
    south, west, north, east = box
    return F.col("lat").between(south, north) & F.col("lon").between(west, east)


def map_addresses(elements: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(lat, lon, number, street) of nodes and ways with a house number inside ``box`` (south, west, north, east); ways by their middle."""
    tag = lambda name: F.nullif(F.trim(F.try_element_at("tags", F.lit(name))), F.lit(""))
    numbered = tag("addr:housenumber").isNotNull()
    nodes = elements.where((F.col("kind") == "node") & numbered & _inside(box)).select("lat", "lon", "tags")
    ways = way_boxes(elements, numbered).where(_inside(box)).select("lat", "lon", "tags")
    return nodes.unionByName(ways).select("lat", "lon", tag("addr:housenumber").alias("number"), tag("addr:street").alias("street"))


def map_buildings(elements: DataFrame, box: tuple[float, float, float, float], most: float = 120.0) -> DataFrame:
    """(lat, lon) of the middles of buildings inside ``box`` that are at most ``most`` metres across."""
    found = way_boxes(elements, F.coalesce(F.try_element_at("tags", F.lit("building")) != "", F.lit(False)))
    return found.where(_inside(box) & (F.col("metres") <= most)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
