"""Operator 9: WARC archives of pages, and their captures in global order by external index merge.

Writing is native: each row becomes a WARC/1.1 record as text, and the record separator
is the text sink's line separator, so tasks write archives to any file system Spark can
write to.  Equal payloads of at least ``least`` bytes are stored once: the largest page_id
has the response, the others are revisit records that refer to it.

Reading parses each archive by its Content-Length headers, checks every stored payload
against its digest, and sorts the archive's captures by URL key, time and page_id: a
locally sorted run.  The runs are cut at common range splitters, and each range of all
runs is merged by a loser tree (k runs, about log2 k comparisons a row).  Splitters use
page_id as well, so one URL with a third of all captures still spreads over many ranges.

Null html is an empty payload; a null url has no URI header and the empty key.  Rows
without a page_id are responses unless their payload is repeated.  Of repeated
rows with the largest page_id every one is a response.  Empty tables give no records.
Pages have no capture time; the date is counted from page_id, a second each.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import columns_as, materialize, over
from marquee.session import scratch_dir

END = "\r\n\r\n"
RECORDS = 16_384  # per archive
EPOCH, SPAN = 1_577_836_800, 10 * 365 * 86_400


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """One column ``value``: the records, without their two closing line ends."""
    rows = columns_as(pages, page="page_id", url="url", html="html").withColumn("page", F.col("page").cast("long"))
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"n": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    twice = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page").alias("origin"), F.count("*").alias("k")).where("k > 1")
    twice = materialize(twice.select("digest", "n", "origin", F.lit(True).alias("shared")), "warc-shared")  # its size is known now
    rows = rows.join(twice, ["digest", "n"], "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page").eqNullSafe(F.col("origin"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    when = F.to_utc_timestamp(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page", F.lit(0)), F.lit(SPAN))), F.current_timezone())
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name("page"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Date: "), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                                 name("origin"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then what follows the host."""
    rest = url.partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def parse(data: memoryview):
    """(offset, headers, block) of each record of an archive."""
    raw, at = data.obj if isinstance(data, memoryview) else data, 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = stop + 4
        end = start + int(headers["Content-Length"])
        if raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut")
        yield at, headers, raw[start:end]
        at = end + 4


def _number(name: str | None) -> int | None:
    return None if name is None or name == "<urn:page:none>" else int(name[len("<urn:page:"):-1])


RUN = "run string, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"


def _runs(batch):
    for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
        out = []
        for at, headers, block in parse(raw.as_py()):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"payload of the record at {at} of {path} is damaged")
            out.append((path, url_key(headers.get("WARC-Target-URI", "")), headers["WARC-Date"], _number(headers["WARC-Record-ID"]), size, digest, kind,
                        _number(headers.get("WARC-Refers-To")), at))
        out.sort(key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0, r[8]))
        yield [list(c) for c in zip(*out)] if out else [[]] * 9


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive under ``path``; each archive's in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return over(files.select("path", "content"), _runs, RUN)


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.tree[node] < 0:  # the first to come waits here
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and (head := self.heads[winner := self.tree[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _merge(batches):
    table = pa.Table.from_batches(list(batches)) if batches else None  # one range of the index
    if table is None or not table.num_rows:
        return None
    cols = {c: table.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id", "offset")}
    keys = list(zip(cols["url_key"], cols["captured"], [(p is not None, p or 0) for p in cols["page_id"]], cols["offset"], range(table.num_rows)))
    starts = [i for i in range(len(keys)) if i == 0 or cols["run"][i] != cols["run"][i - 1]]
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)])]
    return table.take(pa.array([k[4] for k in LoserTree(runs)], pa.int64()))


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures: ranges of (url_key, captured, page_id) in order over the partitions, each merged from its runs."""
    order = ["url_key", "captured", "page_id"]
    index = materialize(runs, "warc-runs")
    dealt = index.repartitionByRange(*order).sortWithinPartitions("run", *order, "offset")

    def merge(batches):
        table = _merge(list(batches))
        if table is not None:
            yield from table.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, index.schema)


def capture_histories(pages: DataFrame, least: int = 1000, path: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives under ``path`` (shared scratch, if none is given), reads them back and merges their indexes."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    write_archives(pages, path, least)
    return merge_runs(read_runs(spark, path))
