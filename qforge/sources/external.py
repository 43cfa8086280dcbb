"""Outside services (OCR, models, search) as callables that the caller brings. Without one, a stub answers null, so jobs run without a network."""

from __future__ import annotations

import contextlib
import os
import signal
import subprocess
import tempfile
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def stub(value: object) -> None:
    """The answer where no service is at hand."""
    return None


def retried(call: Callable[[object], str | None], times: int = 3, wait: float = 3.0, on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> Callable[[object], str | None]:
    """The call, tried again after connection errors; the last error is raised."""

    def run(value: object) -> str | None:
        for left in range(times - 1, -1, -1):
            try:
                return call(value)
            except on:
                if not left:
                    raise
                time.sleep(wait)
        return None

    return run


def within(call: Callable[[object], object], seconds: float) -> Callable[[object], object]:
    """The call, given up with a TimeoutError after so many seconds. What it was doing is left behind on a thread that no process waits for; what runs outside belongs into ``command``, which kills."""

    def run(value: object) -> object:
        done: Future = Future()

        def work() -> None:
            try:
                done.set_result(call(value))
            except BaseException as e:
                done.set_exception(e)

        threading.Thread(target=work, daemon=True).start()
        try:
            return done.result(seconds)
        except TimeoutError:
            if done.done():
                raise  # the call's own
            raise TimeoutError(f"no reply within {seconds:g} s") from None

    return run


def command(argv: list[str], seconds: float, as_argument: bool = True) -> Callable[[object], str]:
    """A program as a service: the request is its last argument, or its input, and what it prints is the reply.

    It runs in a process group of its own, in a folder for temporary files. After so many seconds the whole group is killed, so that what a wrapper has started goes too, and so is what is left of
    the group after a reply. A code other than 0 is an error.
    """

    def run(request: object) -> str:
        text = "" if request is None else str(request)
        child = subprocess.Popen([*argv, text] if as_argument else argv, cwd=tempfile.gettempdir(), stdin=subprocess.DEVNULL if as_argument else subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
        try:
            out, _ = child.communicate(None if as_argument else text, timeout=seconds)
        except subprocess.TimeoutExpired:
            raise TimeoutError(f"{argv[0]} was killed after {seconds:g} s") from None
        finally:
            with contextlib.suppress(ProcessLookupError, PermissionError):
                os.killpg(child.pid, signal.SIGKILL)
            child.wait()
            for stream in (child.stdin, child.stdout):
                if stream:
                    stream.close()
        if child.returncode:
            raise RuntimeError(f"{argv[0]} ended with code {child.returncode}")
        return out

    return run


def pooled(items: Iterable, call: Callable[[object], object], in_flight: int) -> Iterator[tuple[object, object, str | None]]:
    """(item, reply, error) in the order of the items, with at most ``in_flight`` calls open. Items are taken no further ahead than that, so a slow service holds its input back."""

    def tried(item: object) -> tuple[object, str | None]:
        try:
            return call(item), None
        except Exception as e:  # a reply that fails is a result
            return None, str(e)[:500]

    if in_flight <= 1:
        for item in items:
            yield item, *tried(item)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        ahead: deque = deque()
        try:
            for item in items:
                ahead.append((item, pool.submit(tried, item)))
                if len(ahead) >= in_flight:
                    first, reply = ahead.popleft()
                    yield first, *reply.result()
            while ahead:
                first, reply = ahead.popleft()
                yield first, *reply.result()
        finally:
            for _, reply in ahead:
                reply.cancel()


def asked(rows: DataFrame, key: str, request: str, call: Callable[[object], str | None] = stub, at_once: int | None = None, in_flight: int = 1) -> DataFrame:
    """(key, reply, error): one call a row. Failures are told, not raised. ``at_once`` bounds how many tasks call at the same time, ``in_flight`` how many calls each of them has open."""
    kind, sent = rows.schema[key].dataType.simpleString(), rows.schema[request].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = ((k, r) for b in batches for k, r in zip(b["k"], b["r"], strict=True))
        out = []
        for (k, _), reply, error in pooled(each, lambda x: call(x[1]), in_flight):
            out.append((k, reply, error))
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=["k", "reply", "error"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["k", "reply", "error"])

    source = rows.select(F.col(key).alias("k"), F.col(request).cast(sent).alias("r"))
    return (source.repartition(at_once) if at_once else source).mapInPandas(run, f"k {kind}, reply string, error string").withColumnRenamed("k", key)


def fanned(rows: DataFrame, keys: list[str], request: str, call: Callable[[object], Iterable[dict]], replies: str, in_flight: int = 1) -> DataFrame:
    """(keys, nth, fields of ``replies``, error): services with many typed replies a request, images among them. A request that fails is one row with an error, one without replies is none.

    ``replies``: the fields of a reply as a schema, such as "page int, image binary"; ``call`` yields dicts of them, and is read as it yields.
    """
    fields = StructType.fromDDL(replies)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "nth", *fields.names, "error"]

    def run(batches: Iterator) -> Iterator:
        each = (r for b in batches for r in b.to_pylist())
        for r, got, error in pooled(each, lambda r: [dict(x) for x in call(r["_request"])], in_flight):
            out = [{**{k: r[k] for k in keys}, "nth": i, **x, "error": None} for i, x in enumerate(got or [])] if error is None else [{**{k: r[k] for k in keys}, "error": error}]
            if out:
                yield pa.RecordBatch.from_pylist([{c: x.get(c) for c in columns} for x in out], schema=target)

    schema = f"{kinds}, nth int, {replies}, error string"
    target = to_arrow_schema(StructType.fromDDL(schema))
    return rows.select(*keys, F.col(request).alias("_request")).mapInArrow(run, schema)


def first_reply(*replies: Column) -> Column:
    """Of several services' replies the first that is not empty."""
    return F.coalesce(*[F.when(F.trim(r) != "", r) for r in replies])


def without_reasoning(reply: Column) -> Column:
    return F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))


def message(response: Column) -> Column:
    """The content of the first choice of a chat response."""
    return F.get_json_object(response, "$.choices[0].message.content")


def candidates(records: DataFrame, question: Column, options: Column, labels: Column, polluted: Column) -> DataFrame:
    """Records that a verifier is asked about: a question, four options with text, no answer yet, and nothing in them that only a scan leaves."""
    whole = (F.size(options) == 4) & F.forall(options, lambda o: F.trim(o["text"]) != "")
    return records.filter(F.coalesce((F.trim(question) != "") & whole & (F.size(F.coalesce(labels, F.array().cast("array<string>"))) == 0) & ~polluted, F.lit(False)))


def accepted(replies: DataFrame, labels: str, confidence: str, least: float = 0.72) -> DataFrame:
    """Answers that a verifier is sure enough of and that name an option."""
    return replies.filter((F.col(confidence) >= least) & F.exists(labels, lambda x: x.isin("A", "B", "C", "D")))
