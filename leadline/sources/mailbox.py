"""Raw mail that lands as files, read in batches and as a stream: `spark.read.format("mailbox")` after `register(spark)`.

A file holds any number of messages, each behind a line `From <sender> <time>` as in mailboxes of old; a line of a message that begins
so has a > before it. Files come whole and are named in the order in which they land (a later name is a later file). A file is
read in ranges of `split_bytes`: a message belongs to the range in which its first line begins, and a task holds one message at a time.
What a query asks of sender and time is pushed into the reader, which then skips the other messages' bodies.

Options: path; split_bytes; for a stream also agents (comma-joined local parts) and since (ISO time), as streams take no filters.
"""

from __future__ import annotations

import datetime
import io
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull

from leadline.sources.shared import move, path_of, remove

SCHEMA = "file string, position long, agent string, sender string, received timestamp, subject string, raw binary"
#: Who tells of mail that was not delivered, and how many days back a poll looks (OP-I28).
AGENTS, DAYS = ("mailer-daemon", "postmaster"), 3
LINE = re.compile(rb"^From (\S+) (\S+)")
#: One message's header may not take more than this; what follows is body.
HEADER = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Wanted:
    """Which messages a query asks for: local parts of senders, and the least time (the time itself too, if `also`)."""

    agents: frozenset[str] | None = None
    since: datetime.datetime | None = None
    also: bool = True

    def later(self, at: datetime.datetime, also: bool) -> None:
        if self.since is None or at > self.since or (at == self.since and not also):
            self.since, self.also = at, also

    def only(self, agents) -> None:
        self.agents = frozenset(agents) if self.agents is None else self.agents & frozenset(agents)

    def takes(self, agent: str, at: datetime.datetime | None) -> bool:
        if self.agents is not None and agent not in self.agents:
            return False
        return self.since is None or (at is not None and (at > self.since or (self.also and at == self.since)))


def _aware(at: datetime.datetime) -> datetime.datetime:
    return at if at.tzinfo else at.astimezone()


def _files(path: str):
    """(file system, [(file, bytes)]) of a folder of any scheme, hidden files left out, in the order of their names."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"^[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return system, names


def _ranges(names: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(path, i, min(i + size, total)) for path, total in names for i in range(0, total, size)]


def _header(lines: list[bytes]) -> dict[str, str]:
    """The fields of a header by name in lower case, continued lines joined; of equal names the first."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t"):
            if last is not None:
                out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        last = name.strip().lower() if colon and name.strip().lower() not in out else None
        if last is not None:
            out[last] = value.strip()
    return out


def _time(text: str) -> datetime.datetime | None:
    try:
        return _aware(datetime.datetime.fromisoformat(text))
    except ValueError:
        return None


def messages(f, part: Range, wanted: Wanted) -> Iterator[tuple]:
    """Rows of SCHEMA of the messages that begin within a range of an open file."""
    f.seek(max(0, part.start - 1))
    if part.start:
        f.readline()  # to the first line that begins in the range
    at = f.tell()
    row, body, header, size, skip = None, [], [], 0, False

    def done():
        if row is None or skip:
            return None
        raw = b"".join(header + body)
        if raw.endswith(b"\n\n") or raw == b"\n":  # the empty line before the next message
            raw = raw[:-1]
        return (*row, _header(header).get("subject"), raw)

    for line in f:
        here, at = at, at + len(line)
        if line.startswith(b"From ") and (m := LINE.match(line)):
            if (out := done()) is not None:
                yield out
            if here >= part.end:
                return
            sender, received = m[1].decode("utf-8", "replace"), _time(m[2].decode("utf-8", "replace"))
            agent = sender.partition("@")[0].lower()
            row, body, header, size = (part.path, here, agent, sender, received), [], [], 0
            skip, inside = not wanted.takes(agent, received), True
            continue
        if row is None or skip:
            continue
        text = line[1:] if re.match(rb">+From ", line) else line
        if inside and size < HEADER:
            header.append(text)
            size += len(text)
            inside = text.strip() != b""
        else:
            body.append(text)
    if (out := done()) is not None:
        yield out


class _Reading:
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("split_bytes", 64 << 20))
        self.wanted = Wanted()
        if options.get("agents"):
            self.wanted.only(a.strip().lower() for a in options["agents"].split(","))
        if options.get("since"):
            self.wanted.later(_aware(datetime.datetime.fromisoformat(options["since"])), True)

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder has none
            return
        system, _ = _files(self.path)
        with system.open_input_file(partition.path) as f:
            yield from messages(io.BufferedReader(f, 1 << 20), partition, self.wanted)


class MailReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column, value = f.attribute[0] if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if column == "agent" and isinstance(f, EqualTo):
                self.wanted.only([value])
            elif column == "agent" and isinstance(f, In):
                self.wanted.only(value)
            elif column == "received" and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(value, datetime.datetime):
                self.wanted.later(_aware(value), isinstance(f, GreaterThanOrEqual))
            elif not (isinstance(f, IsNotNull) and column in ("agent", "file", "position")):
                yield f

    def partitions(self):
        return _ranges(_files(self.path)[1], self.size)


class MailStream(_Reading, DataSourceStreamReader):
    """The offset is the name of the last file that was read."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = _files(self.path)[1]
        return {"after": names[-1][0] if names else ""}

    def partitions(self, start: dict, end: dict):
        return _ranges([(n, size) for n, size in _files(self.path)[1] if start["after"] < n <= end["after"]], self.size)

    def commit(self, end: dict) -> None:
        pass


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MailReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MailStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)


def deliver(mail: DataFrame, path: str, sender: str = "sender", received: str = "received", raw: str = "raw") -> None:
    """Lands messages (sender, received, raw text) as files in a folder: written beside it, then moved in whole under names behind
    those that are there."""
    spark = mail.sparkSession
    at = F.date_format(F.col(received).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    body = F.regexp_replace(F.regexp_replace(F.col(raw), r"\r\n", "\n"), "(?m)^(>*From )", ">$1")
    line = F.concat(F.lit("From "), F.col(sender), F.lit(" "), at, F.lit("\n"), body, F.when(body.endswith("\n"), "").otherwise("\n"))
    aside = f"{path}/_{uuid.uuid4().hex}"
    mail.select(line.alias("value")).write.text(aside)
    fs, folder = path_of(spark, aside)
    stamp = f"{time.time_ns():020d}"
    parts = sorted(str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    for i, part in enumerate(parts):
        move(spark, part, f"{path}/{stamp}-{i:06d}.mail")
    remove(spark, aside)


def notices(spark: SparkSession, path: str, now: datetime.datetime, agents: tuple[str, ...] = AGENTS, days: int = DAYS) -> DataFrame:
    """Mail of the delivery agents of the last days, as a poll asks for it (OP-I28)."""
    register(spark)
    since = F.lit(now - datetime.timedelta(days=days))
    return spark.read.format("mailbox").load(path).where(F.col("agent").isin(*agents) & (F.col("received") > since))
