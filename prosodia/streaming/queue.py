"""A queue of jobs that is polled over HTTP as a streaming source, and what is told back: results and signs of life."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib import error, request

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "job_id string, text string, voice string, speed double, format string, emphasis boolean"
POLL_S, POST_S = 10.0, 120.0


def fetch(url: str, key: str = "", timeout: float = POLL_S) -> dict | None:
    """The next job, or none where the queue answers that it is empty."""
    with request.urlopen(request.Request(url, headers={"Authorization": key} if key else {}), timeout=timeout) as answer:
        if answer.status == 204:
            return None
        if answer.status != 200:
            raise OSError(f"the queue answered {answer.status}")
        return json.loads(answer.read())


def as_row(job: dict) -> tuple:
    given = job.get("input") or {}
    return (str(job.get("id", "")), given.get("text"), given.get("voice"), given.get("speed"), given.get("format"), given.get("emphasis"))


class QueueReader(SimpleDataSourceStreamReader):
    """Polls for up to ``most`` jobs a batch. A queue hands a job out once, so what was polled is kept until its batch is
    committed and given again if the batch is run again in the same process."""

    def __init__(self, options: dict):
        self.url, self.key, self.most = options["url"], options.get("key", ""), int(options.get("most", 16))
        self.held: dict[int, list[tuple]] = {}

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, rows = start["batch"], []
        while len(rows) < self.most:
            try:
                job = fetch(self.url, self.key)
            except error.URLError:
                break  # the next trigger polls again
            if job is None:
                break
            rows.append(as_row(job))
        if not rows:
            return iter(()), start
        self.held[at] = rows
        return iter(rows), {"batch": at + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row for at in range(start["batch"], end["batch"]) for row in self.held.get(at, [])])

    def commit(self, end: dict) -> None:
        for at in [a for a in self.held if a < end["batch"]]:
            del self.held[at]


class QueueSource(DataSource):
    """``spark.dataSource.register(QueueSource)``, then ``readStream.format("job_queue").option("url", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> QueueReader:
        return QueueReader(self.options)


def result_url(base: str, job_id: str) -> str:
    """Where a job's result goes: $ID is its id, and it is no stream."""
    url = base.replace("$ID", job_id, 1)
    return url + ("&" if "?" in url else "?") + "isStream=false"


def ping_url(base: str, job_id: str = "") -> str:
    return base + ("&" if "?" in base else "?") + f"job_id={job_id}" if job_id else base


def poster(base: str, key: str = "", send: Callable | None = None) -> Callable:
    """A ``post`` for serving.serve(): results are sent from the executors that hold them, one request each."""

    def post(frame, number: int) -> None:
        def run(rows) -> None:
            put = send or send_json
            for row in rows:
                put(result_url(base, row["job_id"]), row["body"], key)

        frame.foreachPartition(run)

    return post


def send_json(url: str, body: str, key: str = "") -> int:
    headers = {"Content-Type": "application/json", **({"Authorization": key} if key else {})}
    with request.urlopen(request.Request(url, body.encode(), headers, method="POST"), timeout=POST_S) as answer:
        return answer.status


class Heartbeat(StreamingQueryListener):
    """Tells a queue that the worker lives: a GET at each progress of a query, and while it is idle. A ping that fails is
    let go; the next one comes."""

    def __init__(self, url: str, get: Callable[[str], object] | None = None):
        self.url, self.sent, self.get = url, 0, get or (lambda u: request.urlopen(u, timeout=POLL_S).close())

    def ping(self, job_id: str = "") -> None:
        try:
            self.get(ping_url(self.url, job_id))
            self.sent += 1
        except OSError:
            pass

    def onQueryStarted(self, event) -> None:
        self.ping()

    def onQueryProgress(self, event) -> None:
        self.ping(str(event.progress.batchId))

    def onQueryIdle(self, event) -> None:
        self.ping()

    def onQueryTerminated(self, event) -> None:
        pass
