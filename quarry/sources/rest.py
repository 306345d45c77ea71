"""REST knowledge base as a Spark data source: one partition per listing page.

    spark.dataSource.register(ArticleSource)
    spark.read.format("kb_articles").options(base_url=..., email=..., password=...).load()

The driver only asks each section for its page count; pages and articles are fetched by
the tasks.  A failing article becomes a row with `error` set, so one bad article never
fails the scan; `readable_articles` keeps the good rows.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.rules.russian import DEFAULT_SECTION_IDS

SCHEMA = (
    "id long, name string, content string, preview string, editor_type string, status string, "
    "section_id string, updated_at string, error string"
)
FIELDS = ("name", "content", "preview", "editor_type", "status", "section_id", "updated_at")
# FIXED VALUES: routes of the knowledge-base API
LOGIN, TREE = "api/auth/logininng", "api/knowledgebase/tree/full"
SECTION, ARTICLE = "api/knowledgebase/section/{}/articles", "api/knowledgebase/article/{}"
ATTEMPTS = 4

# (method, url, body, headers) -> (http status, decoded JSON)
Transport = Callable[[str, str, dict | None, dict], tuple[int, object]]


class TransportError(RuntimeError):
    pass


def http_transport(method: str, url: str, body: dict | None, headers: dict) -> tuple[int, object]:
    data = json.dumps(body).encode() if body is not None else None
    request = urllib.request.Request(
        url, data, {"Accept": "application/json", "Content-Type": "application/json", **headers}, method=method
    )
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read() or b"null")
    except urllib.error.HTTPError as e:
        return e.code, None
    except (urllib.error.URLError, TimeoutError) as e:
        raise TransportError(str(e)) from e


class Api:
    """Authorised GETs: re-login on 401, growing pauses on transport errors."""

    def __init__(self, options: dict, transport: Transport, pause: Callable[[float], None] = time.sleep) -> None:
        self.base = options["base_url"].rstrip("/")
        self.credentials = {"email": options.get("email", "").strip(), "password": options.get("password", "")}
        if not all(self.credentials.values()):
            raise ValueError("email and password are required")
        if options.get("token_name"):
            self.credentials["token_name"] = options["token_name"]
        self.transport, self.pause, self.token = transport, pause, ""

    def login(self) -> None:
        status, payload = self.transport("POST", f"{self.base}/{LOGIN}", self.credentials, {})
        token = payload.get("access_token") if status < 300 and isinstance(payload, dict) else None
        if not isinstance(token, str) or not token.strip():
            raise RuntimeError(f"login was refused (HTTP {status})")
        self.token = token.strip()

    def get(self, path: str, **params) -> object:
        url = f"{self.base}/{path}" + (f"?{urllib.parse.urlencode(params)}" if params else "")
        last = "unauthorised"
        for attempt in range(ATTEMPTS):
            if not self.token:
                self.login()
            try:
                status, payload = self.transport("GET", url, None, {"Authorization": f"Bearer {self.token}"})
            except TransportError as e:
                last = str(e)
                self.pause(2 * (attempt + 1))
                continue
            if status == 401 and attempt < ATTEMPTS - 1:
                self.token = ""
                continue
            if status >= 300:
                raise RuntimeError(f"GET /{path} returned HTTP {status}")
            return payload
        raise RuntimeError(f"GET /{path} failed after {ATTEMPTS} attempts: {last}")

    def sections(self) -> list[int]:
        try:
            payload = self.get(TREE)
        except RuntimeError:
            return list(DEFAULT_SECTION_IDS)
        items = payload.values() if isinstance(payload, dict) else payload or []
        found = {
            int(i["id"]) for i in items
            if isinstance(i, dict) and i.get("type") == "section" and str(i.get("id", "")).isdigit()
        }
        return sorted(found) or list(DEFAULT_SECTION_IDS)

    def page(self, section: int, page: int, per_page: int) -> tuple[list[dict], int, bool]:
        """(summaries, last page, has next link)."""
        payload = self.get(SECTION.format(section), page=page, per_page=per_page)
        if isinstance(payload, list):
            items, last, more = payload, page, False
        elif isinstance(payload, dict):
            items = payload.get("data", [])
            last = int((payload.get("meta") or {}).get("last_page") or page)
            more = bool((payload.get("links") or {}).get("next"))
        else:
            raise RuntimeError("unexpected listing payload")
        if not isinstance(items, list):
            raise RuntimeError("listing field `data` must be an array")
        return [i for i in items if isinstance(i, dict)], last, more

    def article(self, summary: dict) -> dict:
        payload = self.get(ARTICLE.format(summary["id"]))
        data = payload.get("data") if isinstance(payload, dict) else None
        if not isinstance(data, dict):
            raise RuntimeError("article payload has no data object")
        return {**summary, **data}


@dataclass
class PageSlice(InputPartition):
    section: int
    first: int
    last: int | None        # None: follow `next` links to the end


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.per_page = max(1, min(int(options.get("per_page", 200)), 700))

    def _api(self) -> Api:
        hook = self.options.get("transport", "quarry.sources.rest:http_transport")
        module, name = hook.split(":")
        return Api(self.options, getattr(importlib.import_module(module), name))

    def partitions(self) -> list[PageSlice]:
        api = self._api()
        wanted = int(self.options.get("section_id", 0))
        if wanted < 0:
            raise ValueError("section_id must not be negative")
        slices = []
        for section in [wanted] if wanted else api.sections():
            _, last, _ = api.page(section, 1, self.per_page)
            slices += [PageSlice(section, p, p) for p in range(1, last)] + [PageSlice(section, last, None)]
        return slices

    def read(self, partition: PageSlice) -> Iterator[tuple]:
        api, page = self._api(), partition.first
        while True:
            summaries, last, more = api.page(partition.section, page, self.per_page)
            for s in summaries:
                if s.get("id") is not None:
                    yield self._row(api, s, partition.section)
            if partition.last is not None or (page >= last and not more):
                return
            page += 1

    @staticmethod
    def _row(api: Api, summary: dict, section: int) -> tuple:
        try:
            a = api.article(summary)
        except RuntimeError as e:
            return (int(summary["id"]), *[None] * len(FIELDS), str(e)[:1000])
        a["section_id"] = a.get("section_id") or section
        return (int(a["id"]), *[None if a.get(f) is None else str(a[f]) for f in FIELDS], None)


class ArticleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kb_articles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArticleReader:  # noqa: ANN001
        return ArticleReader(dict(self.options))


def source_key(base_url: str, section_id: int = 0, kb_name: str = "kb") -> str:
    return f"{kb_name}:{base_url.rstrip('/')}:section:{section_id or 'all'}"


def readable_articles(articles: DataFrame, max_articles: int = 0) -> DataFrame:
    good = articles.filter(F.col("error").isNull()).drop("error")
    # the first ones by section and id, so that a limit does not depend on task timing
    ordered = good.orderBy(F.col("section_id").cast("long").asc_nulls_last(), "id")
    return ordered.limit(max_articles) if max_articles else good
