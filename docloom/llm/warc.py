"""Web archives: write pages as WARC records, index the captures, merge the index, read the archives back.

Each task writes one or more gzipped archives and hands on, for each, a capture run: its index lines sorted by
URL key, time and page. The runs are merged externally. A range partitioning cuts the key space into
ranges of bounded size at full keys, so that captures of one URL may span ranges; within a range the slice of each run is
written as a sorted file, and a loser tree merges the files with a bounded buffer for each. Ranges in order are the globally ordered capture histories.

Archives lie in the shared folder and are reached by its URI through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import io
import re
import zlib
from datetime import UTC, datetime, timedelta
from hashlib import sha1
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stage, table, text_of

ARCHIVE_BYTES = 64 << 20  # of records before compression; bounds what a task holds
RANGE_ROWS = 200_000  # index lines that a merging task holds, about
MIN_PAYLOAD = 0
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
SPREAD = 10**9  # seconds over which capture times spread
BUFFER_ROWS = 512  # lines of each run that a merging task holds
MANY_RUNS = 128  # runs merged at once; more are merged in passes
PAGE_ID = "urn:docloom:page:"

_INDEX = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()),
                    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
_INDEX_DDL = "run string, seq bigint, url_key string, stamp string, page_id bigint, archive string, offset bigint, length bigint, digest string, record_type string"
_READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_DDL = "archive string, offset bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: str) -> str:
    """Sort-friendly key: host parts reversed, without www, scheme, default port, user and fragment; lower case."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower().partition("#")[0])
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.", "", re.sub(r":(80|443)$", "", host.rpartition("@")[2]))
    return f"{','.join(reversed(host.split('.')))}){slash}{path}"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _record(page_id, url: str, when: datetime, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_ID}{page_id}>",
            f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_ID}{refers_to}>"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:/", uri) else f"file://{uri}")


def _writer(folder: str):
    """Writes the rows of a task. A task that runs again writes archives of its own; only those it names in its rows count."""
    def run(batches):
        context = TaskContext.get()
        store, top = _filesystem(folder)
        store.create_dir(top, recursive=True)
        name = f"run-{context.stageId()}-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, lines, raw, n = io.BytesIO(), [], 0, 0

        def close():
            nonlocal out, lines, raw, n
            archive = f"{name}-{n:04d}.warc.gz"
            with store.open_output_stream(f"{top}/{archive}") as f:
                f.write(out.getbuffer())
            lines.sort(key=lambda x: (x["url_key"], x["stamp"], -1 if x["page_id"] is None else x["page_id"]))
            made = pa.RecordBatch.from_pylist([x | {"run": archive, "archive": archive, "seq": i} for i, x in enumerate(lines)], _INDEX)
            out, lines, raw, n = io.BytesIO(), [], 0, n + 1
            return made

        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                when = EPOCH + timedelta(seconds=(r["at"] or 0) % SPREAD)
                digest = base64.b32encode(sha1(payload).digest()).decode()
                member = gzip.compress(_record(r["page_id"], r["url"], when, payload, digest, r["refers_to"]), 6, mtime=0)
                lines.append({"url_key": url_key(r["url"]), "stamp": f"{when:%Y%m%d%H%M%S}", "page_id": r["page_id"], "offset": out.tell(), "length": len(member),
                              "digest": digest, "record_type": "response" if r["refers_to"] is None else "revisit"})
                out.write(member)
                raw += len(payload)
                if raw >= ARCHIVE_BYTES:
                    yield close()
        if lines:
            yield close()
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write a record for each page and return the capture runs (index lines; run and seq give the local order).

    Of pages with equal payloads of at least min_payload bytes the one with the smallest id is written as a response and the others as revisits of it;
    smaller payloads are all responses. Null html is an empty payload. A null url is about:blank, a null id is
    written as such and never referred to. Pages that repeat id and payload are all responses where theirs is the smallest id. Capture times are EPOCH plus the id in seconds, modulo SPREAD."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    src = src.withColumn("_digest", F.unhex(F.sha1("html"))).withColumn("_bytes", F.octet_length("html"))
    first = src.where((F.col("_bytes") >= min_payload)).groupBy(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stage(first.where("_n > 1 AND _first IS NOT NULL").drop("_n"), "warc-first")
    joined = src.join(first, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows = joined.select("page_id", "url", "html", refers.alias("refers_to"), F.coalesce("page_id", F.lit(0)).alias("at"))
    return stage(rows.mapInArrow(_writer(folder), _INDEX_DDL), "warc-runs")


def loser_tree(runs: list):
    """Merge sorted iterators of comparable items; one comparison a level for each item taken.

    tree[i] for 0 < i < k holds the run that lost at node i, tree[0] the winner; leaf of run r is node k + r."""
    k, done = len(runs), (1,)
    heads = [(0, x) if (x := next(r, None)) is not None else done for r in runs]
    tree = [-1] * max(1, k)
    for r in range(k):  # play each run up from its leaf; the first to come to a node waits there
        node = (k + r) // 2
        while node and tree[node] >= 0:
            if heads[tree[node]] < heads[r]:
                tree[node], r = r, tree[node]
            node //= 2
        tree[node] = r
    while k and heads[r := tree[0]] is not done:
        yield heads[r][1]
        x = next(runs[r], None)
        heads[r] = done if x is None else (0, x)
        node = (k + r) // 2
        while node:
            if heads[tree[node]] < heads[r]:
                tree[node], r = r, tree[node]
            node //= 2
        tree[0] = r


def _key(r: dict) -> tuple:
    return r["url_key"], r["stamp"], -1 if r["page_id"] is None else r["page_id"], r["run"], r["seq"]


def _lines(store, path: str):
    """The lines of a sorted file, a batch of BUFFER_ROWS at a time."""
    with store.open_input_stream(path) as f, pa.ipc.open_stream(f) as stream:
        for batch in stream:
            for r in batch.to_pylist():
                yield _key(r), r


def _write(store, path: str, rows) -> str:
    with store.open_output_stream(path) as f, pa.ipc.new_stream(f, _INDEX) as out:
        held = []
        for r in rows:
            held.append(r)
            if len(held) == BUFFER_ROWS:
                out.write_batch(pa.RecordBatch.from_pylist(held, _INDEX))
                held = []
        if held:
            out.write_batch(pa.RecordBatch.from_pylist(held, _INDEX))
    return path


def _merger(folder: str):
    """The rows of a range come run by run, each slice in order: they go to a file each in the shared folder, and the files are merged and removed."""
    def run(batches):
        context = TaskContext.get()
        part = context.partitionId()
        store, top = _filesystem(folder)
        top = f"{top}/range-{part:06d}-{context.taskAttemptId()}"
        rows = (r for batch in batches for at in range(0, batch.num_rows, BUFFER_ROWS) for r in batch.slice(at, BUFFER_ROWS).to_pylist())
        files, held = [], []
        for i, (_, slice_) in enumerate(groupby(rows, key=lambda r: r["run"])):
            if not i:
                store.create_dir(top, recursive=True)
            files.append(_write(store, f"{top}/{i}", slice_))
        made, some = len(files), bool(files)
        while len(files) > MANY_RUNS:
            files = [*files[MANY_RUNS:], _write(store, f"{top}/{made}", (r for _, r in loser_tree([_lines(store, f) for f in files[:MANY_RUNS]])))]
            made += 1
        for at, (_, r) in enumerate(loser_tree([_lines(store, f) for f in files])):
            held.append(r | {"range_no": part, "range_at": at})
            if len(held) == 5000:
                yield pa.RecordBatch.from_pylist(held, _MERGED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _MERGED)
        if some:
            store.delete_dir(top)
    return run


_MERGED = _INDEX.append(pa.field("range_no", pa.int32())).append(pa.field("range_at", pa.int64()))


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture histories in global order: index lines with history_at, their place from 0 on."""
    n = max(1, -(-runs.count() // range_rows))
    cut = runs.repartitionByRange(n, "url_key", "stamp", F.coalesce("page_id", F.lit(-1)), "run", "seq").sortWithinPartitions("run", "seq")
    merged = stage(cut.mapInArrow(_merger(new_path(runs.sparkSession, "warc-merge")), _INDEX_DDL + ", range_no int, range_at bigint"), "warc-merged")
    sizes = merged.groupBy(F.col("range_no").alias("r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = stage(sizes.select("r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("s")), "warc-starts")
    return merged.join(starts, F.col("range_no") == F.col("r")).withColumn("history_at", F.col("s") + F.col("range_at")).drop("r", "s", "range_no", "range_at")


def records(stream):
    """(offset, headers, block) of each member of a gzipped archive, one record at a time."""
    offset, data = 0, b""
    while True:
        data = data or stream.read(1 << 16)
        if not data:
            return
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not data and not (data := stream.read(1 << 16)):
                raise ValueError("archive ends within a record")
            parts.append(inflate.decompress(data))
            used += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield offset, fields, block[: int(fields["Content-Length"])]
        offset += used


def _reader(folder: str):
    def run(batches):
        store, top = _filesystem(folder)
        ident = lambda v: None if v.endswith(":None>") else int(v[len(PAGE_ID) + 1 : -1])
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                found = []
                with store.open_input_stream(f"{top}/{archive}") as f:
                    for offset, fields, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        seen, told = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
                        if seen and (len(payload) != size or base64.b32encode(sha1(payload).digest()).decode() != told):
                            raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
                        found.append({"archive": archive, "offset": offset, "page_id": ident(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": told,
                                      "record_type": fields["WARC-Type"], "refers_to": None if seen else ident(fields["WARC-Refers-To"])})
                        if len(found) == 5000:
                            yield pa.RecordBatch.from_pylist(found, _READ)
                            found = []
                yield pa.RecordBatch.from_pylist(found, _READ)
    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """What the named archives hold: a row a record, its payload checked against its digest. archives: a column archive of distinct names.

    Each archive is a partition of its own, as far as hashing tells them apart; a number given outright is kept by adaptive execution."""
    n = max(1, archives.count())
    return archives.repartition(n, "archive").mapInArrow(_reader(folder), _READ_DDL)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    runs = write_archives(table(spark, sf_dir, "pages"), folder)
    histories = merge_runs(runs).select(F.col("archive").alias("_a"), F.col("offset").alias("_o"))
    found = read_archives(stage(runs.select("archive").distinct(), "warc-archives"), folder)
    # both sides are large and of one size: by archive and offset, merged
    return histories.hint("merge").join(found, (F.col("_a") == F.col("archive")) & (F.col("_o") == F.col("offset"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f"""}
