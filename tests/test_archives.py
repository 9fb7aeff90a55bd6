import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from lodestay.sources import archives


def test_tables_of_zipped_timetables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stops.txt", '﻿stop_name,stop_id,extra\n"North, gate",1,x\nשער,2,\n'.encode())
        z.writestr("trips.txt", "trip_id\n" + "".join(f"t{i}\n" for i in range(20_000)))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("stops.txt", "stop_id\n3\n")
    (tmp_path / "c.txt").write_text("no zip")
    stops = archives.zipped_csv(spark, str(tmp_path), "stops.txt", ["stop_id", "stop_name", "extra"])
    assert sorted(map(tuple, stops.collect())) == [("1", "North, gate", "x"), ("2", "שער", None), ("3", None, None)]
    assert archives.zipped_csv(spark, str(tmp_path), "trips.txt", ["trip_id"]).distinct().count() == 20_000
    assert archives.zipped_csv(spark, str(tmp_path), "none.txt", ["x"]).count() == 0


def test_placemarks_of_zipped_map_files(spark, tmp_path):
    mark = "<Placemark id='1'><name>{}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>\n {} </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    body = mark.format("<![CDATA[zone]]>", "34.1,32.0,0 34.2,32.0,0\n34.2,32.1,0") + mark.format("line", "34.1,32.0 34.2,32.0")
    with zipfile.ZipFile(tmp_path / "z.kmz", "w") as z:
        z.writestr("doc.kml", f"<kml><Document>{body}</Document></kml>")
        z.writestr("icon.png", b"png")
    rows = archives.zipped_placemarks(spark, str(tmp_path)).collect()
    assert [(r.name, [tuple(p) for p in r.ring]) for r in rows] == [("zone", [(32.0, 34.1), (32.0, 34.2), (32.1, 34.2)])]


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(n):
    return varint(n << 1 ^ n >> 63)


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values))  # noqa: B905


def block(nodes, ways, dense, packed, lat0=0):
    """A blob of nodes (id, lat, lon, tags) and ways (id, refs, tags)."""
    words = [""]

    def word(w):
        if w not in words:
            words.append(w)
        return words.index(w)

    place = lambda lat, lon: (round((lat * 1e9 - lat0) / 100), round(lon * 1e9 / 100))
    if dense:
        tags = b"".join(b"".join(varint(word(k)) + varint(word(v)) for k, v in t.items()) + varint(0) for *_, t in nodes)
        group = field(2, field(1, deltas([n[0] for n in nodes])) + field(8, deltas([place(*n[1:3])[0] for n in nodes])) + field(9, deltas([place(*n[1:3])[1] for n in nodes])) + field(10, tags))
    else:
        one = lambda i, lat, lon, t: varint(1 << 3) + zigzag(i) + field(2, b"".join(varint(word(k)) for k in t)) + field(3, b"".join(varint(word(v)) for v in t.values())) + varint(8 << 3) + zigzag(place(lat, lon)[0]) + varint(9 << 3) + zigzag(place(lat, lon)[1])
        group = b"".join(field(1, one(*n)) for n in nodes)
    group += b"".join(field(3, field(1, i) + field(2, b"".join(varint(word(k)) for k in t)) + field(3, b"".join(varint(word(v)) for v in t.values())) + field(8, deltas(refs))) for i, refs, t in ways)
    raw = field(1, b"".join(field(1, w.encode()) for w in words)) + field(2, group) + (field(19, lat0) if lat0 else b"")
    return field(2, len(raw)) + field(3, zlib.compress(raw)) if packed else field(1, raw)


def written(path, blobs):
    out = b""
    for kind, blob in [(b"OSMHeader", field(1, b"x")), *((b"OSMData", b) for b in blobs)]:
        head = field(1, kind) + field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    path.write_bytes(out)


NODES = [(1, 31.25, 34.79, {"addr:housenumber": " 5 ", "addr:street": "רגר"}), (2, 31.2501, 34.79, {}), (3, 31.2501, 34.7902, {}), (4, 31.25, 34.7902, {}), (9, -33.5, -70.25, {"addr:housenumber": "1"}), (5, 31.26, 34.8, {"addr:housenumber": ""})]
WAYS = [(7, [1, 2, 3, 4, 1], {"building": "yes", "addr:housenumber": "7"}), (8, [1, 9], {"building": "yes"}), (10, [404], {"building": "yes"}), (11, [2, 3], {"highway": "road"})]


def test_map_extracts_are_read_back_equal(spark, tmp_path):
    written(tmp_path / "a.osm.pbf", [block(NODES[:3], [], True, True), block(NODES[3:], [], False, False), block([], WAYS, True, True)])
    written(tmp_path / "b.osm.pbf", [block([(20, -1.5, 2.5, {"k": "v"}), (21, -1.5, 2.5, {})], [], True, False, lat0=-1_000_000_000)])
    elements = archives.map_elements(spark, str(tmp_path), tasks=3)
    rows = elements.collect()
    nodes = {r.id: (round(r.lat, 7), round(r.lon, 7), r.tags) for r in rows if r.kind == "node"}
    assert nodes == {i: (lat, lon, t) for i, lat, lon, t in NODES} | {20: (-1.5, 2.5, {"k": "v"}), 21: (-1.5, 2.5, {})}
    assert {r.id: (r.refs, r.tags) for r in rows if r.kind == "way"} == {i: (refs, t) for i, refs, t in WAYS}
    box = (31.0, 34.0, 32.0, 35.0)
    found = {(round(r.lat, 6), round(r.lon, 6), r.number, r.street) for r in archives.map_addresses(elements, box).collect()}
    assert found == {(31.25, 34.79, "5", "רגר"), (31.25005, 34.7901, "7", None)}
    assert [tuple(r) for r in archives.map_buildings(elements, box).collect()] == [(31.25005, 34.7901)]
    assert archives.way_boxes(elements, F.col("tags")["building"] == "yes").count() == 2
