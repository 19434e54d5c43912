"""Landed pages and JSON: block tables, message lists, event and company pages, search answers, cache keys."""

from __future__ import annotations

import operator
import re
from bisect import bisect_left
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.functions import text

# How ids and numbers are written in links and pages.
EVENT_ID = r"(?i)EventId=([A-Za-z0-9_\-]+)"
EVENT_PATH = r"(?i)/(?:event|events|soobshhenie|soobshheniya|message|messages|news)/([A-Za-z0-9_\-]{3,})"
COMPANY_ID = r"(?i)company\.aspx\?id=(\d+)"
INN, OGRN, OKPO = r"ИНН\D{0,20}?(\d{10}|\d{12})\b", r"ОГРН\D{0,20}?(\d{13}|\d{15})\b", r"ОКПО\D{0,20}?(\d{8,10})\b"


def date_chunks(span: DataFrame, days: int) -> DataFrame:
    """(chunk_from, chunk_till) cutting the one-row span (a, b) into pieces of ``days`` days."""
    starts = span.select(F.explode(F.sequence(F.col("a"), F.col("b"), F.expr(f"INTERVAL {days} DAY"))).alias("chunk_from"), "b")
    return starts.select("chunk_from", F.least(F.date_add("chunk_from", days - 1), F.col("b")).alias("chunk_till"))


def cache_key(method: Column, url: Column, params: Column | None = None, data: Column | None = None) -> Column:
    """sha1 of ``METHOD address?parameters#body``; parameters and body are maps of a name to its values, in the order of ``name=value|value``."""

    def pairs(m: Column | None) -> Column:
        if m is None:
            return F.lit("")
        each = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.concat_ws("|", e["value"])))
        return F.coalesce(F.concat_ws("&", F.array_sort(each)), F.lit(""))

    return F.sha1(F.concat(F.upper(method), F.lit(" "), url, F.lit("?"), pairs(params), F.lit("#"), pairs(data)))


# What tells a captcha and a browser check from a page, and in how many first characters.
CAPTCHA_MARKS, CAPTCHA_WITHIN = ["sp_rotated_captcha", "captchaintgen", '"is_captcha":true', '"is_captcha": true'], 60_000
STUB_MARKS, STUB_WITHIN = ["id_captcha_frame_div", "spinner-container", "id_spinner", "__sp_init", "spsc="], 40_000
REDIRECT_MARKS = ['http-equiv="refresh"', "<noscript>", "<script"]


def page_class(html: Column) -> Column:
    """captcha, stub (a browser check) or content; a redirecting page without any link is a check as well."""
    low = F.lower(F.coalesce(html, F.lit("")))
    head = lambda n: F.left(low, F.lit(n))
    holds = lambda c, marks, how: reduce(how, [c.contains(m) for m in marks])
    redirects = holds(head(STUB_WITHIN), REDIRECT_MARKS, operator.and_) & ~low.contains("<a ")
    return F.when(holds(head(CAPTCHA_WITHIN), CAPTCHA_MARKS, operator.or_), "captcha").when(holds(head(STUB_WITHIN), STUB_MARKS, operator.or_) | redirects, "stub").otherwise("content")


# Encodings that a server names when it does not know, and the one of old pages.
UNKNOWN_ENCODINGS, OLD_ENCODING = ("iso-8859-1", "latin-1", "latin1"), "cp1251"


def decode_body(body: bytes | None, encoding: str | None) -> str | None:
    """A landed body as text: by the declared encoding, as UTF-8, else by what its first bytes look like."""
    if body is None:
        return None
    declared = (encoding or "").lower()
    for name in ([declared] if declared and declared not in UNKNOWN_ENCODINGS else []) + ["utf-8"]:
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return body.decode("utf-8" if b"\xd0" in body[:2000] else OLD_ENCODING, errors="replace")


def decoded(bodies: DataFrame, body_col: str = "body", encoding_col: str = "encoding") -> DataFrame:
    """``bodies`` with the column ``decoded``."""

    @F.pandas_udf("string")
    def run(body: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([decode_body(None if b is None else bytes(b), e) for b, e in zip(body, encoding, strict=True)], dtype=object)

    return bodies.withColumn("decoded", run(F.col(body_col), F.col(encoding_col)))


# How pages say how many pages or messages there are.
PAGES_OF, FOUND = r"(?i)(?u)(?:Страниц[аы]?|Стр\.)\s*\d+\s*(?:из|/)\s*(\d+)", r"(?i)(?u)Найдено\D{0,20}(\d[\d ]*)"


def total_pages(html: Column) -> Column:
    """How many pages (or messages) a list page announces; NULL where it does not."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    flat = F.regexp_replace(F.regexp_replace(bare, "&nbsp;|\u00a0", " "), r"\s+", " ")
    return F.coalesce(_first(flat, PAGES_OF), F.regexp_replace(_first(flat, FOUND), " ", "")).try_cast("bigint")


def listed_pages(pages: DataFrame, block: str, key: str, start: str = "start", limit: int = 100, json_col: str = "payload") -> DataFrame:
    """The landed pages that belong to each list (``key``), in one pass over them.

    A list ends with an empty page, with the page that reaches the cursor's total, or, without a cursor, with one of fewer
    than ``limit`` rows; pages that lie beyond are left out.
    """
    kind = f"struct<`{block}`: struct<data: array<array<string>>>, `{block}.cursor`: struct<columns: array<string>, data: array<array<string>>>>"
    p = F.from_json(F.col(json_col), kind)
    cursor = p[f"{block}.cursor"]
    names, row = F.transform(cursor["columns"], lambda x: F.upper(x)), F.get(cursor["data"], F.lit(0))
    of = lambda n: F.get(row, (F.array_position(names, n) - 1).cast("int")).try_cast("bigint")
    size = F.coalesce(F.size(p[block]["data"]), F.lit(0))
    size = F.when(size < 0, 0).otherwise(size)
    known = of("TOTAL").isNotNull() & (F.coalesce(of("PAGESIZE"), F.lit(0)) > 0)
    last = (size == 0) | F.when(known, F.col(start) + of("PAGESIZE") >= of("TOTAL")).otherwise(size < limit)
    seen = W.partitionBy(key).orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    marked = pages.withColumn("_size", size).withColumn("_last", last).withColumn("_over", F.coalesce(F.max("_last").over(seen), F.lit(False)))
    return marked.filter("_size > 0 AND NOT _over").drop("_size", "_last", "_over")


def link_patterns(pages: DataFrame) -> DataFrame:
    """Link targets with digits masked, and how often each is found."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select(href.alias("href")).groupBy(F.regexp_replace("href", "[0-9]+", "N").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def _first(c: Column, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found)


def extract_ids(c: Column) -> list[Column]:
    """Columns inn, ogrn, okpo, company_id and event_id: the first of each that is found in a page; an event's number goes before a path."""
    numbers = [_first(c, pattern).alias(name) for name, pattern in (("inn", INN), ("ogrn", OGRN), ("okpo", OKPO))]
    return [*numbers, _first(c, COMPANY_ID).try_cast("bigint").alias("company_id"), F.coalesce(_first(c, EVENT_ID), _first(c, EVENT_PATH)).alias("event_id")]


def json_block(payloads: DataFrame, block: str, columns: dict[str, str], json_col: str = "payload") -> DataFrame:
    """Rows of {block: {columns: [...], data: [[...]]}}: the named columns, cast without failing; absent ones are NULL.

    Columns are found by name (case ignored), so their order in the answer does not matter.
    """
    kind = f"struct<`{block}`: struct<columns: array<string>, data: array<array<string>>>>"
    b = F.from_json(F.col(json_col), kind)[block]
    names = F.transform(b["columns"], lambda x: F.upper(x))
    rows = payloads.select(names.alias("_n"), F.explode(b["data"]).alias("_d"))
    value = lambda n: F.when(F.array_position("_n", n.upper()) > 0, F.get("_d", (F.array_position("_n", n.upper()) - 1).cast("int")))
    return rows.select(*[value(n).try_cast(t).alias(n.lower()) for n, t in columns.items()])


HISTORY = {"TRADEDATE": "date", "SECID": "string", "OPEN": "double", "HIGH": "double", "LOW": "double", "CLOSE": "double", "VOLUME": "double", "VALUE": "double", "NUMTRADES": "double"}


def history_to_prices(payloads: DataFrame) -> DataFrame:
    """Price rows of history answers: whole volumes (half to even), no day without a close, the last row of a date."""
    from tapeline.operators.panel import keep_one

    h = json_block(payloads, "history", HISTORY).withColumn("_seq", F.monotonically_increasing_id()).filter("close IS NOT NULL AND tradedate IS NOT NULL")
    whole = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 0).cast("bigint")
    p = h.select(F.col("tradedate").alias("date"), "secid", "open", "high", "low", "close", whole(F.col("volume")).alias("volume"), "value", whole(F.col("numtrades")).alias("numtrades"), "_seq")
    return keep_one(p, ["secid", "date"], [F.desc("_seq")]).drop("_seq")


def index_history(payloads: DataFrame) -> DataFrame:
    """(date, close) of an index's history answers, the last row of a date; days without a level are left out."""
    from tapeline.operators.panel import keep_one

    h = json_block(payloads, "history", {"TRADEDATE": "date", "CLOSE": "double"}).withColumn("_seq", F.monotonically_increasing_id())
    rows = h.filter("close IS NOT NULL AND tradedate IS NOT NULL").select(F.col("tradedate").alias("date"), "close", "_seq")
    return keep_one(rows, ["date"], [F.desc("_seq")]).drop("_seq")


def listed_securities(payloads: DataFrame) -> DataFrame:
    """Securities of list answers in their canonical shape, one row each: a traded one before another, then by content."""
    from tapeline.operators.panel import keep_one
    from tapeline.schema import SECURITIES, conform, fields

    rows = conform(json_block(payloads, "securities", {n.upper(): "string" for n, _ in fields(SECURITIES)}), SECURITIES).filter("secid IS NOT NULL")
    return keep_one(rows, ["secid"], [F.col("is_traded").desc_nulls_last(), F.col("shortname").asc_nulls_last(), F.col("primary_boardid").asc_nulls_last()])


def security_description(payloads: DataFrame, key: str = "secid", json_col: str = "payload") -> DataFrame:
    """key, a map of the description's names to values, and the primary board."""
    kind = "struct<description: struct<columns: array<string>, data: array<array<string>>>, boards: struct<columns: array<string>, data: array<array<string>>>>"
    p = F.from_json(F.col(json_col), kind)
    at = lambda b, n: (F.array_position(p[b]["columns"], n) - 1).cast("int")
    pairs = F.map_from_entries(F.transform(p["description"]["data"], lambda d: F.struct(F.get(d, at("description", "name")).alias("k"), F.get(d, at("description", "value")).alias("v"))))
    primary = F.filter(p["boards"]["data"], lambda d: F.get(d, at("boards", "is_primary")) == "1")
    return payloads.select(key, pairs.alias("description"), F.get(F.get(primary, F.lit(0)), at("boards", "boardid")).alias("primary_board"))


# Names under which search answers carry their lists, fields and totals; where an event's page is.
LIST_KEYS = ["foundEventsList", "events", "items", "data", "list", "rows", "result", "results"]
ALIASES = {
    "event_id": ["pseudoguid", "eventguid", "eventid", "guid", "id", "code"], "company_id": ["companyid", "company_id", "companycode", "orgid"],
    "company_name": ["companyname", "company", "orgname", "shortname"], "event_type": ["eventname", "eventtype", "name", "title", "highlighted"],
    "published_at": ["eventdate", "publishdate", "publicationdate", "date", "datetime", "time", "created", "dt"],
}
TOTAL_KEYS = ["totalCount", "total", "count", "found", "recordsTotal", "eventsCount"]
LONG_ID = r"^[A-Za-z0-9_\-]{16,}$"
SITE, EVENT_URL = "https://e-disclosure.ru", "/portal/event.aspx?EventId="


def any_datetime(c: Column) -> Column:
    iso = F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)", 0)
    return F.coalesce(F.regexp_replace(F.when(iso != "", iso), "T", " ").try_cast("timestamp_ntz"), text.parse_datetime(c))


def _found_list(answer: Column) -> Column:
    """The first list of objects of an answer, as maps: under one of the known names, else under any, else the answer itself."""
    fields = F.from_json(answer, "map<string,string>")
    objects = lambda c: F.when(F.ltrim(F.regexp_replace(c, r"^\s*\[\s*", "[")).startswith("[{"), F.from_json(c, "array<map<string,string>>"))
    known = [objects(fields[k]) for k in LIST_KEYS]
    anywhere = F.get(F.filter(F.transform(F.map_values(fields), objects), lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.ltrim(answer).startswith("["), F.from_json(answer, "array<map<string,string>>")).otherwise(F.coalesce(*known, anywhere))


def search_json(payloads: DataFrame, json_col: str = "payload", site: str = SITE) -> DataFrame:
    """Messages of search answers, whatever the names of the list and its fields (case ignored)."""
    rows = payloads.select(F.explode(_found_list(F.col(json_col))).alias("raw")).filter("raw IS NOT NULL").withColumn("m", F.transform_keys("raw", lambda k, v: F.lower(k)))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    pick = lambda f: F.coalesce(*[blank(F.col("m")[k]) for k in ALIASES[f]])
    values = F.map_values("m")
    token = F.get(F.filter(values, lambda v: v.rlike(LONG_ID)), F.lit(0))
    when = F.coalesce(*[any_datetime(F.col("m")[k]) for k in ALIASES["published_at"]], F.get(F.filter(F.transform(values, any_datetime), lambda x: x.isNotNull()), F.lit(0)))
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\u00a0]+", " "))
    event = F.coalesce(pick("event_id"), token)
    bare = F.regexp_replace(F.coalesce(pick("event_type"), F.lit("")), "<[^>]*>", " ")
    out = rows.select(event.alias("event_id"), pick("company_id").try_cast("bigint").alias("company_id"), flat(pick("company_name")).alias("company_name"), when.alias("published_at"), flat(bare).alias("event_type"))
    return out.filter("event_id IS NOT NULL").withColumn("url", F.concat(F.lit(site + EVENT_URL), "event_id"))


def search_total(answer: Column) -> Column:
    """How many messages an answer says were found."""
    fields = F.from_json(answer, "map<string,string>")
    return F.coalesce(*[F.when(fields[k].rlike(r"^-?\d+$"), fields[k]).try_cast("bigint") for k in TOTAL_KEYS])


# ---------------------------------------------------------------- HTML


def cached_answers(requests: DataFrame, answers: DataFrame, ttl_seconds: int) -> DataFrame:
    """``requests`` (key, asked_at, any others) with the answer that a cache would give: landed_at and body of the newest good answer that is not expired.

    ``answers`` are (key, landed_at, body); pages that are no content (captchas, stubs, empty bodies) are never kept. An answer serves the
    stretch of ``ttl_seconds`` that it lands in and the next, so a key is dealt by (key, stretch) and one that most rows share is many groups.
    """
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (ttl_seconds * 1_000_000)).cast("bigint")
    good = answers.filter((F.length(F.coalesce("body", F.lit(""))) > 0) & (page_class(F.col("body")) == "content") & F.col("key").isNotNull())
    kept = good.select("key", F.explode(F.array(stretch("landed_at"), stretch("landed_at") + 1)).alias("_part"), F.col("landed_at").alias("_at"), F.struct("landed_at", "body").alias("_answer"))
    asked = requests.select(F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("_request"), F.col("key"), stretch("asked_at").alias("_part"), F.col("asked_at").alias("_at"))
    both = kept.unionByName(asked, allowMissingColumns=True)
    order = W.partitionBy("key", "_part").orderBy("_at", F.col("_request").isNotNull(), F.col("_answer.body")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_answer", F.last("_answer", True).over(order)).filter("_request IS NOT NULL")
    alive = F.unix_micros(F.col("_at").cast("timestamp")) < F.unix_micros(F.col("_answer.landed_at").cast("timestamp")) + ttl_seconds * 1_000_000
    return found.select("_request.*", *[F.when(alive, F.col(f"_answer.{c}")).alias(c) for c in ("landed_at", "body")])


# Elements whose text is not a page's own, and names of the block that holds an event's text.
SILENT = frozenset({"script", "style", "noscript", "iframe", "svg"})
AROUND = SILENT | {"header", "footer", "nav", "form"}
TEXT_BLOCKS, TEXT_LEAST = ["cont_wrap", "eventText", "event", "news", "content", "main"], 200
RESULT_BLOCKS = ["searchResults", "searchResult", "results", "eventsList"]
# How a page's text states its fields.
MOMENT = r"\d{2}\.\d{2}\.\d{4}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?"
STATED = {
    "published_at": rf"(?i)(?:Дата\s+(?:публикации|размещения|раскрытия)|Опубликовано)\D{{0,15}}({MOMENT})",
    "event_type": r"(?i)(?:Тип\s+(?:сообщения|события)|Существенн\S+\s+факт)\s*[:\-–—]?\s*(.+)",
    "company_name": r"(?i)(?:Полное фирменное наименование эмитента|Эмитент)\D{0,10}[:\-–—]\s*(.+)",
}
HEAD, LONGEST = 600, 300
# Classes of elements that hold one message and of lines that name issuer and kind, what separates the two there,
# and how many blocks above the nearest one may hold a message.
ROW_CLASS = r"table__row|row|item"
INFO_CLASS = r"info"
INFO_SEPARATOR = r"\s*[,;]\s+|\s\|\s|\s—\s|\s–\s"
CLIMBS = 4


class _Tree(HTMLParser):
    """A flat list of (depth, tag, attributes, text parts, parent) of a page; text belongs to all open elements."""

    VOID = {"br", "img", "input", "meta", "link", "hr", "col", "base", "source", "wbr"}

    def __init__(self, silent: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.silent = silent
        self.nodes: list[dict] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"tag": tag, "attrs": dict(attrs), "text": [], "parent": self.stack[-1] if self.stack else -1})
        if tag == "br":
            self._say("\n")
        if tag not in self.VOID:
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]]["tag"] == tag:
                del self.stack[k:]
                break

    def _say(self, data):
        for i in self.stack:
            self.nodes[i]["text"].append(data)

    def handle_data(self, data):
        if not any(self.nodes[i]["tag"] in self.silent for i in self.stack):
            self._say(data)
            self._say(" ")


def _clean(s: str) -> str:
    return re.sub(r"\s+", " ", s.replace(" ", " ")).strip()


def tree(html: str | None, silent: frozenset[str] = SILENT) -> list[dict]:
    t = _Tree(silent)
    t.feed(html or "")
    return t.nodes


def _text(node: dict) -> str:
    return _clean("".join(node["text"]))


def _datetime(s: str):
    from datetime import datetime

    m = re.search(r"(\d{2})\.(\d{2})\.(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?", s)
    if not m:
        return None
    try:
        return datetime(int(m[3]), int(m[2]), int(m[1]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0))
    except ValueError:
        return None


def _search(pattern: str, s: str) -> str | None:
    m = re.search(pattern, s)
    return m[1] if m else None


def _event_of(href: str) -> str | None:
    return _search(EVENT_ID, href) or _search(EVENT_PATH, href.split("?")[0])


class _Layout:
    """Where the elements of a page lie: their descendants, as a stretch of the flat list, and the holders of messages around them."""

    def __init__(self, nodes: list[dict]):
        self.nodes = nodes
        self.end = [i + 1 for i in range(len(nodes))]
        #: Of each element the nearest row, element of a row's class and list entry around it (-1: none), and the blocks, from the inside out.
        self.around: list[tuple[int, int, int, tuple[int, ...]]] = []
        for node in nodes:
            p = node["parent"]
            if p < 0:
                self.around.append((-1, -1, -1, ()))
                continue
            row, classed, entry, blocks = self.around[p]
            own = nodes[p]
            kind = own["tag"]
            self.around.append((
                p if kind == "tr" else row, p if re.search(ROW_CLASS, own["attrs"].get("class") or "", re.I) else classed,
                p if kind == "li" else entry, (p, *blocks)[: CLIMBS + 1] if kind == "div" else blocks,
            ))
        for i in range(len(nodes) - 1, -1, -1):
            if (p := nodes[i]["parent"]) >= 0:
                self.end[p] = max(self.end[p], self.end[i])

    def holder(self, i: int) -> int:
        """The element that is one message: by kind, else a block near by that has a date, else the farthest of them, else the link itself."""
        *named, blocks = self.around[i]
        found = [j for j in named if j >= 0] or [j for j in blocks if _datetime(_text(self.nodes[j]))] or list(blocks[CLIMBS:])
        return found[0] if found else i

    def first(self, places: list[int], i: int, below: bool = False) -> int | None:
        """The first of ``places`` (ascending) inside an element or, unless only ``below`` it, at it."""
        k = bisect_left(places, i + below)
        return places[k] if k < len(places) and places[k] < self.end[i] else None


def message_rows(html: str | None, site: str = SITE, only_results: bool = False) -> list[dict]:
    """Messages of a list page, each event once; ``only_results`` looks into the block of results alone.

    The page becomes three lists of places (links to events, links to issuers, lines that name both); each holder of a link is then one
    message, of the first place of each list that lies inside it.
    """
    nodes = tree(html)
    layout = _Layout(nodes)
    href = [(n["attrs"].get("href") or "") if n["tag"] == "a" else "" for n in nodes]
    events = [i for i, h in enumerate(href) if _event_of(h)]
    issuers = [i for i, h in enumerate(href) if _search(COMPANY_ID, h)]
    infos = [i for i, n in enumerate(nodes) if re.search(INFO_CLASS, n["attrs"].get("class") or "", re.I)]
    asked = events
    if only_results:
        named = {n["attrs"].get("id"): i for i, n in reversed(list(enumerate(nodes)))}
        block = next((named[x] for x in RESULT_BLOCKS if x in named), None)
        asked = [] if block is None else [i for i in events if block < i < layout.end[block]]
    out: dict[str, dict] = {}
    for holder in dict.fromkeys(map(layout.holder, asked)):
        link, issuer, info = layout.first(events, holder), layout.first(issuers, holder), layout.first(infos, holder, below=True)
        said = [x.strip() for x in re.split(INFO_SEPARATOR, _text(nodes[info])) if x.strip()] if info is not None else []
        name, kind = "" if issuer is None else _text(nodes[issuer]), _text(nodes[link]) or _cell(nodes, link)
        if not name and said:
            name, kind = said[0], kind or ", ".join(said[1:])
        out.setdefault(_event_of(href[link]), {
            "event_id": _event_of(href[link]), "company_id": None if issuer is None else int(_search(COMPANY_ID, href[issuer])), "company_name": name,
            "published_at": _datetime(_text(nodes[holder])), "event_type": kind, "url": urljoin(site, href[link]),
        })
    return list(out.values())


def _cell(nodes: list[dict], i: int) -> str:
    """The text of the nearest cell, block or entry around an element."""
    while (i := nodes[i]["parent"]) >= 0:
        if nodes[i]["tag"] in ("td", "div", "li"):
            return _text(nodes[i])
    return ""


def search_results(html: str | None, site: str = SITE) -> list[dict]:
    """Messages of a search page: those in its block of results, else (old pages) all."""
    return message_rows(html, site, only_results=True) or message_rows(html, site)


MESSAGE = "event_id string, company_id bigint, company_name string, published_at timestamp_ntz, event_type string, url string"
EVENT_PAGE = "event_id string, title string, company_name string, company_id bigint, published_at timestamp_ntz, body_text string, event_type string"
COMPANY_PAGE = "company_id bigint, name string, inn string, ogrn string, okpo string, region string"


def _head(nodes: list[dict]) -> str:
    return next((_text(n) for tag in ("h1", "h2", "title") for n in nodes if n["tag"] == tag), "")


def _company_link(nodes: list[dict]) -> tuple[int | None, str]:
    return next(((int(c), _text(n)) for n in nodes if n["tag"] == "a" and (c := _search(COMPANY_ID, n["attrs"].get("href") or ""))), (None, ""))


def _lines(parts: list[str]) -> str:
    """Pieces of text as lines without blank ones."""
    return "\n".join(x for x in map(_clean, "\n".join(parts).split("\n")) if x)


def _event_text(html: str | None) -> str:
    """The text of an event page: its named block where that is long enough, else the body, line by line."""
    nodes = tree(html, AROUND)
    for name in TEXT_BLOCKS:
        by = [next((n for n in nodes if re.search(name, n["attrs"].get(a) or "", re.I)), None) for a in ("id", "class")]
        block = by[0] or by[1]
        if block and len(_text(block)) > TEXT_LEAST:
            return _lines(block["text"])
    body = next((n for n in nodes if n["tag"] == "body"), None)
    return _lines(body["text"] if body else [x for n in nodes if n["parent"] < 0 for x in n["text"]])


def event_page(html: str | None) -> dict:
    """Id, title, company, time, type and text of an event page: from its links, else as its text states them."""
    nodes, body = tree(html), _event_text(html)
    stated = {name: _clean(_search(pattern, body) or "") for name, pattern in STATED.items()}
    number, name = _company_link(nodes)
    links = [n["attrs"].get("href") or "" for tag in ("a", "link") for n in nodes if n["tag"] == tag and (tag == "a" or "canonical" in (n["attrs"].get("rel") or ""))]
    return {
        "event_id": next((e for e in (_search(EVENT_ID, h) for h in links) if e), ""), "title": _head(nodes), "company_name": name or stated["company_name"][:LONGEST], "company_id": number,
        "published_at": _datetime(stated["published_at"]) or _datetime(body[:HEAD]), "body_text": body, "event_type": stated["event_type"][:LONGEST],
    }


def company_page(html: str | None) -> dict:
    nodes = tree(html)
    whole = "".join(x for n in nodes if n["parent"] < 0 for x in n["text"])
    flat = _clean(whole)
    region = _search(r"Регион\s*:?\s*([^\n]{1,80})", "\n".join(x for x in map(_clean, re.split(r"\n", whole)) if x))
    return {"company_id": _company_link(nodes)[0], "name": _head(nodes), "inn": _search(INN, flat), "ogrn": _search(OGRN, flat), "okpo": _search(OKPO, flat), "region": _clean(region) if region else None}


def _parsed(pages: DataFrame, parse, ddl: str, out: str, html_col: str) -> DataFrame:
    names = [x.split()[0] for x in ddl.split(", ")]

    @F.pandas_udf(ddl)
    def udf(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h) for h in html], columns=names)

    return pages.withColumn(out, udf(F.col(html_col)))


def event_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return _parsed(pages, event_page, EVENT_PAGE, "event", html_col)


def company_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return _parsed(pages, company_page, COMPANY_PAGE, "company", html_col)


def message_lists(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row a message of every list page."""
    @F.pandas_udf("array<struct<" + ", ".join(": ".join(x.split()) for x in MESSAGE.split(", ")) + ">>")
    def rows(html: pd.Series) -> pd.Series:
        return pd.Series([message_rows(h) for h in html])

    return pages.select(F.explode(rows(F.col(html_col))).alias("m")).select("m.*")


def scan_event_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Event pages kept as JSON files, one page a line as ``save_events_json`` writes them; ``multi_line`` for one page a file over several lines."""
    return spark.read.schema(EVENT_PAGE).option("multiLine", multi_line).json(path)
