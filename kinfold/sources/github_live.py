"""Live profiles as a data source: spark.read.format("code_profiles").option("users", "ann,bo").load().

Users are dealt to partitions, and each partition's reader fetches its own.  A call that fails for a
moment (no connection, a server error) is made again after growing pauses.  A server that refuses
because of its rate limit says when it will answer again; if that is soon enough, the reader waits,
else the user is reported as refused, and so are the partition's other users without a call.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is fetched of a profile.
API = "https://api.github.com"
CALLS = {"user": "/users/{0}", "repos": "/users/{0}/repos?per_page=100&sort=updated", "social_accounts": "/users/{0}/social_accounts", "readme": "/repos/{0}/{0}/readme"}
#: The payload's parts as JSON text, and why there is none of the user (null if there is one).
SCHEMA = "username string, user string, repos string, social_accounts string, readme string, problem string"
REFUSED, UNKNOWN, FAILED = "refused by the rate limit", "no such user", "no answer"


class Refused(Exception):
    """The server's rate limit forbids further calls for longer than a reader waits."""


@dataclass
class Client:
    """Calls of one server, with a pause before each repetition."""

    base: str = API
    token: str = ""
    timeout: float = 10.0
    tries: int = 3
    pause: float = 0.5
    longest_wait: float = 60.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def get(self, path: str) -> tuple[int, str | None]:
        """Status and body of a reply; 0 without one."""
        headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        status = 0
        for attempt in range(self.tries):
            wait = self.pause * 2**attempt
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base + path, headers=headers), timeout=self.timeout) as reply:
                    return reply.status, reply.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as error:
                status = error.code
                if status in (403, 429) and (limit := self._limit(error)) is not None:
                    if limit > self.longest_wait or attempt + 1 == self.tries:
                        raise Refused(path) from error
                    wait = limit
                elif status < 500:
                    return status, None
            except (OSError, ValueError):
                status = 0
            if attempt + 1 < self.tries:
                self.sleep(wait)
        return status, None

    @staticmethod
    def _limit(error: urllib.error.HTTPError) -> float | None:
        """Seconds until the server answers again, if it refuses because of its rate limit."""
        if (after := error.headers.get("Retry-After")) and after.isdigit():
            return float(after)
        if error.headers.get("X-RateLimit-Remaining") == "0" and (reset := error.headers.get("X-RateLimit-Reset", "")).isdigit():
            return max(0.0, float(reset) - time.time())
        return 60.0 if error.code == 429 else None

    def payload(self, name: str) -> tuple:
        """A row of SCHEMA; parts that fail are left out, and without the user nothing else is called."""
        parts: dict[str, str | None] = dict.fromkeys(CALLS)
        problem = None
        for part, call in CALLS.items():
            try:
                status, body = self.get(call.format(name))
            except Refused:
                if part == "user":
                    raise
                break
            parts[part] = body if _is(body, list if part in ("repos", "social_accounts") else dict) else None
            if part == "user" and parts["user"] is None:
                problem = UNKNOWN if status == 404 else FAILED
                break
        return name, *parts.values(), problem

    def payloads(self, names: Iterator[str]) -> Iterator[tuple]:
        refused = False
        for name in names:
            if not refused:
                try:
                    yield self.payload(name)
                    continue
                except Refused:
                    refused = True
            yield name, None, None, None, None, REFUSED


def _is(body: str | None, kind: type) -> bool:
    try:
        return body is not None and isinstance(json.loads(body), kind)
    except ValueError:
        return False


@dataclass
class Users(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Users]:
        names = list(dict.fromkeys(n.strip() for n in self.options.get("users", "").split(",") if n.strip()))
        n = max(1, min(int(self.options.get("partitions", "8")), len(names)))
        return [Users(names[i::n]) for i in range(n)]

    def read(self, partition: Users) -> Iterator[tuple]:
        known = {"base": str, "token": str, "timeout": float, "tries": int, "pause": float, "longestWait": float}
        given = {("longest_wait" if k == "longestWait" else k): kind(self.options[k]) for k, kind in known.items() if k in self.options}
        yield from Client(**given).payloads(iter(partition.names))


class CodeProfiles(DataSource):
    """Options: users (names with commas), partitions, base, token, timeout, tries, pause and longestWait (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "code_profiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))
