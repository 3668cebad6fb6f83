"""Batches of requests to a service: a file of requests, a job that is asked for until it ends, and its results joined back.

The service is an object with upload(lines) -> file id, create(file id) -> job, status(job id) -> job, content(file
id) -> lines, jobs(limit) -> list of jobs and models() -> list of names; a job is a dict of id, status and
output_file_id. HttpBatchService speaks to one of the common kind; tests give their own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators import generate, metrics
from glossmill.plans.staging import removed, shared_path, staged

#: How a job ends, the form of a request, and how often it is asked for.
ENDED_WELL, ENDED_BADLY = "completed", ("failed", "expired", "cancelled")
ENDPOINT, EVERY_SECONDS = "/v1/chat/completions", 60
#: Requests of a job at most: more are several jobs.
JOB_REQUESTS = 50_000

RESULT = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:long,completion_tokens:long>,error:struct<message:string>>>, error struct<message:string>"


def requests(prompts: DataFrame, model: str, key: str, max_tokens: int = 1024) -> DataFrame:
    """prompts with custom_id, and the request's line (value)."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.array(message("system", "system_prompt"), message("user", "user_prompt")).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.col("temperature").alias("temperature"),
    )
    rows = prompts.withColumn("custom_id", F.concat(F.lit("request-"), F.col(key).cast("string")))
    return rows.withColumn(
        "value", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(ENDPOINT).alias("url"), body.alias("body")))
    )


def results(lines: DataFrame) -> DataFrame:
    """custom_id, status_code, content, prompt_tokens, completion_tokens, error of result lines (value)."""
    r = lines.select(F.from_json("value", RESULT).alias("r"))
    return r.select(
        "r.custom_id", F.col("r.response.status_code").alias("status_code"), F.get("r.response.body.choices", F.lit(0))["message"]["content"].alias("content"),
        F.col("r.response.body.usage.prompt_tokens").alias("prompt_tokens"), F.col("r.response.body.usage.completion_tokens").alias("completion_tokens"),
        F.coalesce("r.error.message", "r.response.body.error.message").alias("error"),
    )


def wait(service, job: dict, every: float = EVERY_SECONDS, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The job when it has ended."""
    while job["status"] != ENDED_WELL and job["status"] not in ENDED_BADLY:
        sleep(every)
        job = service.status(job["id"])
    return job


def run(
    prompts: DataFrame, service, model: str, key: str, provider=None, max_tokens: int = 1024, job_requests: int = JOB_REQUESTS,
    every: float = EVERY_SECONDS, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """prompts' key with text, cost, tokens, success and error, at the price of a batch.

    Requests go out as jobs of job_requests lines, one of which the driver holds at a time; results are written to the
    shared folder job by job and joined by custom_id, a request without one being an error. Requests of jobs that end
    badly are asked for one by one (provider: what makes the provider for that), or are errors without it.
    """
    spark = prompts.sparkSession
    rows = staged(requests(prompts, model, key, max_tokens), "batch-requests")
    at = shared_path(spark, "batch-results")
    spark.createDataFrame([], "value string").write.text(at)
    lost: list[tuple[str, str]] = []
    # every job is under way before the first is waited for; a job's ids aren't kept, but its bounds in their order
    pending = [(service.create(service.upload(lines)), first, last) for first, last, lines in jobs_of(rows, job_requests)]
    for job, first, last in pending:
        job = wait(service, job, every, sleep)
        if job["status"] == ENDED_WELL:
            spark.createDataFrame(
                [(x,) for x in service.content(job["output_file_id"])], "value string"
            ).coalesce(1).write.mode("append").text(at)
        else:
            lost.append((first, last))
    found = results(spark.read.text(at))
    again = F.lit(False)
    for first, last in lost:
        again = again | F.col("custom_id").between(first, last)
    out = metrics.batch_results(rows.filter(~again).select(key, "custom_id"), found, model)
    columns = [key, "text", "cost", "total_tokens", "success", "error", "batch_mode"]
    out = out.select(columns)
    if lost:
        left = rows.filter(again)
        if provider is None:
            none = {"text": F.lit(None).cast("string"), "cost": F.lit(0.0), "total_tokens": F.lit(None).cast("long")}
            said = {"success": F.lit(False), "error": F.lit("the batch ended badly"), "batch_mode": F.lit(True)}
            why = left.select(key, *[x.alias(n) for n, x in (none | said).items()])
        else:
            called = staged(generate.call(left, provider, [key], max_tokens), "batch-fallback")
            why = called.select(
                key, "text", "cost", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "success", "error",
                F.lit(False).alias("batch_mode"),
            )
        out = out.unionByName(why)
    out = staged(out, "batch-rows")
    removed(spark, at)
    return out


def jobs_of(rows: DataFrame, size: int) -> Iterator[tuple[str, str, list[str]]]:
    """The first and last custom_id and the lines of each job, in the order of custom_id."""
    part: list[tuple[str, str]] = []
    for r in rows.select("custom_id", "value").orderBy("custom_id").toLocalIterator():  # partition by partition
        part.append((r["custom_id"], r["value"]))
        if len(part) == size:
            yield part[0][0], part[-1][0], [x[1] for x in part]
            part = []
    if part:
        yield part[0][0], part[-1][0], [x[1] for x in part]


def list_jobs(service, limit: int = 10) -> list[dict]:
    """The latest jobs of a service, as it gives them."""
    return list(service.jobs(limit))[:limit]


def list_models(service) -> list[str]:
    """Names of the models that a service offers; none if it can't be asked."""
    try:
        return sorted(service.models())
    except Exception:  # a service that doesn't answer offers nothing
        return []


class HttpBatchService:
    """A service of the common kind, by its address and the variable that holds its key; ask(method, address, body, headers)
    gives the answer's bytes."""

    def __init__(self, base: str, key_variable: str, ask: Callable[..., bytes] | None = None):
        from glossmill.sources.io import api_key

        self.base, self.ask = base.rstrip("/"), ask or ask_http
        self.headers = {"Authorization": f"Bearer {api_key(key_variable)}"}

    def _json(self, method: str, path: str, body: bytes | None = None, kind: str = "application/json") -> dict:
        return json.loads(self.ask(method, f"{self.base}{path}", body, self.headers | {"Content-Type": kind}))

    def upload(self, lines: list[str]) -> str:
        mark = "----glossmill-part"
        head = f'--{mark}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n--{mark}\r\nContent-Disposition: form-data; name="file"; filename="requests.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n'
        body = head.encode() + "\n".join(lines).encode() + f"\r\n--{mark}--\r\n".encode()
        return self._json("POST", "/files", body, f"multipart/form-data; boundary={mark}")["id"]

    def create(self, file_id: str) -> dict:
        return self._json(
            "POST", "/batches", json.dumps({"input_file_id": file_id, "endpoint": ENDPOINT, "completion_window": "24h"}).encode()
        )

    def status(self, job_id: str) -> dict:
        return self._json("GET", f"/batches/{job_id}")

    def content(self, file_id: str) -> list[str]:
        return self.ask("GET", f"{self.base}/files/{file_id}/content", None, self.headers).decode().splitlines()

    def jobs(self, limit: int) -> list[dict]:
        return self._json("GET", f"/batches?limit={limit}")["data"]

    def models(self) -> list[str]:
        return [m["id"] for m in self._json("GET", "/models")["data"]]


def ask_http(method: str, url: str, body: bytes | None, headers: dict[str, str], seconds: float = 60) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=seconds) as r:
        return r.read()
