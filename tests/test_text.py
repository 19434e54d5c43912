"""Titles, numbers, names, roles, stake changes, pages."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.functions import text
from tapeline.operators import mapping
from tapeline.sources import feeds


def one(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.o for r in df.select("k", expr(F.col("v")).alias("o")).orderBy("k").collect()]


def test_numbers_and_dates(spark):
    assert one(spark, ["0,0012 %", "1 234,5", "не применимо", "1 000", None], text.parse_number) == [0.0012, 1234.5, None, 1000.0, None]
    got = one(spark, ["от 15.03.2024 12:30", "31.02.2024", "01.02.2023", "x", None], text.parse_datetime)
    assert got == [datetime(2024, 3, 15, 12, 30), None, datetime(2023, 2, 1), None, None]


def test_tax_numbers(spark):
    cases = {"7707083893": "7707083893", "7707083893.0": "7707083893", "ИНН 7707083893": "7707083893", "123456789012": "123456789012", "123": None, "": None, None: None, "77-0708-3893": "7707083893"}
    assert one(spark, list(cases), text.normalize_inn) == list(cases.values())


def test_titles(spark):
    cases = {
        "Об изменении размера доли участия члена органа управления эмитента": "insider_stake_change", "Сведения об инсайдерах": "insider_transactions", "О приобретении эмитентом собственных акций": "buyback",
        "Годовой отчёт": "financial_statements", "Дефолт": "default_or_debt", "О прочем": "other", None: "other",
    }
    assert one(spark, list(cases), text.classify) == list(cases.values())


def test_titles_are_classified_once(spark, monkeypatch):
    """The same categories from distinct titles as row by row and as from one expression a category; patterns are not in the plan over messages."""
    import random

    rng, parts = random.Random(7), sorted({x for _, _, ps in text.CATEGORIES for p in ps for x in re.findall("[а-я]{3,}", p)})
    titles = ["".join(rng.choice(["", " ", "ые ", "х "]) + rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(1500)] + ["", " ", "Ёж", None, "x" * 100_000, "Годовой отчёт", "годовой  отчет"]
    # And a title that each pattern was made for: the first of every choice, nothing of what may be anything.
    titles += [re.sub(r"\\S\*|\.\*", "", re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", p)) for _, _, ps in text.CATEGORIES for p in ps]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(titles * 2)], "k int, event_type string, category string")
    t = text.norm_title(F.col("event_type"))
    plain = None
    for name, _, ps in text.CATEGORIES:
        if ps:
            found = t.rlike("|".join(f"(?:{p})" for p in ps))
            plain = F.when(found, name) if plain is None else plain.when(found, name)
    want = {r.k: r.c for r in df.select("k", plain.otherwise("other").alias("c")).collect()}
    once = mapping.classify_messages(df)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan(once) and sorted(once.columns) == ["category", "direction", "event_type", "k"]
    assert {r.k: r.category for r in once.collect()} == want and len(set(want.values())) > 20
    monkeypatch.setattr(mapping, "MOST_TITLES", 10)
    each = mapping.classify_messages(df)
    assert "RLIKE" in plan(each) and sorted(each.select("k", "category", "direction").collect()) == sorted(once.select("k", "category", "direction").collect())
    assert mapping.classify_messages(df.limit(0)).count() == 0
    odd = [("first", "neutral", ["^a|b$", "(?i)HIT"]), ("second", "neutral", ["c.d+"]), ("rest", "neutral", [])]
    assert one(spark, ["ax", "xb", "xhitx", "cxddd", "cd", None], lambda c: text.classify(c, odd)) == ["first", "first", "first", "second", "rest", "rest"]


def test_roles(spark):
    cases = {"Председатель Совета директоров": "board_chair", "Генеральный директор": "ceo", "Вице-президент": "management_board", "И.о. генерального директора": "management_board", "член наблюдательного совета": "board", "акционер": "other", "": "unknown"}
    assert one(spark, list(cases), text.classify_role) == list(cases.values())


STAKES = [
    ("2.1. Фамилия, имя, отчество: Иванов И.И.\n2.2. Должность: Член правления\n2.3. Размер доли до изменения: 0,10 %\n2.4. Размер доли после изменения: 0,15 %\n2.5. Дата, в которую эмитент узнал: 15.03.2024",
     {"person": "Иванов И.И.", "position": "Член правления", "share_before": 0.1, "share_after": 0.15, "change_date": date(2024, 3, 15), "direction": 1, "is_subsidiary": False}),
    ("Наименование подконтрольной организации: ООО Ромашка\nДоля в подконтрольной организации до изменения: 2\nДоля в подконтрольной организации после изменения: 0",
     {"organization": "ООО Ромашка", "is_subsidiary": True, "share_before": 2.0, "share_after": 0.0, "direction": -1, "delta_pp": -2.0}),
    (None, {"person": None, "direction": 0, "delta_pp": None, "is_subsidiary": False, "change_date": None}),
    # an empty organization is taken and names nothing; the second is named; the third is free again and says a share
    ("Наименование подконтрольной организации: не применимо\nНаименование подконтрольной организации: АО Б;\nНаименование подконтрольной организации, доля до изменения: 7 %",
     {"organization": "АО Б", "is_subsidiary": True, "share_before": 7.0, "share_after": None, "direction": 0}),
    # the first person takes the clause, a second one may say the position; no such day is taken as a date
    ("ФИО: А; \nФИО и должность: Б\nДата изменения: 31.02.2024\nДата, когда получено уведомление: до 01.02.2024: 05.02.2024 и доля до изменения: 3",
     {"person": "А", "position": "Б", "change_date": date(2024, 2, 1), "share_before": None}),
    # common shares decide where the issuer's are incomplete; a clause of both times counts for the open one
    ("Доля до изменения: 1\nДоля обыкновенных акций до изменения и после изменения: 5\nДоля обыкновенных акций до изменения и после изменения: 4,5",
     {"share_before": 1.0, "share_after": None, "common_before": 5.0, "common_after": 4.5, "direction": -1, "delta_pp": -0.5}),
    ("2.1. ФИО: Петров 2.2. Должность: Генеральный директор 2.3. Доля эмитента до изменения: 1\u00a0234,5 % 2.4. Доля эмитента после изменения: не применимо",
     {"person": "Петров", "position": "Генеральный директор", "share_before": 1234.5, "share_after": None}),
]


def test_stake(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(STAKES)], "k int, body_text string")
    got = {r.k: r.stake for r in text.stake_changes(df).collect()}
    for k, (t, want) in enumerate(STAKES):
        for name, v in want.items():
            assert got[k][name] == (pytest.approx(v) if isinstance(v, float) else v), (t, name)
    assert "Python" not in text.stake_changes(df)._jdf.queryExecution().toString()


def test_primary_and_confounders(spark):
    rows = [("AAAA", "7707083893", 1, "common_share"), ("AAAP", "7707083893", 1, "preferred_share"), ("BB", "7707083894", 0, "common_share"), ("BBB", "7707083894", 1, "common_share"), ("X", None, 1, "common_share")]
    s = spark.createDataFrame([(a, a, b, c, d, "АО") for a, b, c, d in rows], "secid string, shortname string, emitent_inn string, is_traded long, type string, emitent_title string")
    assert {r.secid for r in mapping.primary_security(s).filter("primary").collect()} == {"AAAA", "BBB"}
    e = spark.createDataFrame([("a", "S", datetime(2024, 1, 1), "rating"), ("b", "S", datetime(2024, 1, 6), "financial_statements"), ("c", "S", datetime(2024, 1, 12), "rating"), ("d", "T", datetime(2024, 1, 6), "financial_statements")], "event_id string, secid string, published_at timestamp_ntz, category string")
    assert {r.event_id: r.has_confounder for r in mapping.flag_confounders(e).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_confounders_by_running_windows(spark):
    """Equal moments, the very ends of the five days and rows without a time, as every pair gives; no frame of days is added up anew for each row."""
    rnd = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(f"e{k}", f"S{rnd.randrange(4)}", None if k % 40 == 7 else start + timedelta(days=rnd.randrange(60), microseconds=rnd.choice((0, 0, 0, 1))), rnd.choice(["other"] * 9 + ["dividends_decision"])) for k in range(400)]
    got = mapping.flag_confounders(spark.createDataFrame(rows, "event_id string, secid string, published_at timestamp_ntz, category string"))
    near = lambda a, b: a[0] != b[0] and a[1] == b[1] and b[3] != "other" and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= timedelta(days=5)
    assert {r.event_id: r.has_confounder for r in got.collect()} == {a[0]: any(near(a, b) for b in rows) for a in rows}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RangeFrame, unboundedpreceding$()") == plan.count("RangeFrame") == 2


def test_pages():
    rows = feeds.message_rows("<table><tr><td>01.02.2024&nbsp;10:15</td><td><a href='/portal/company.aspx?id=7'>ПАО</a></td><td><a href='/portal/event.aspx?EventId=AbC-1'>О дивидендах</a></td></tr></table>")
    assert rows == [{"event_id": "AbC-1", "company_id": 7, "company_name": "ПАО", "published_at": datetime(2024, 2, 1, 10, 15), "event_type": "О дивидендах", "url": "https://e-disclosure.ru/portal/event.aspx?EventId=AbC-1"}]
    assert feeds.message_rows("") == [] and feeds.message_rows(None) == []
    row = "<tr><td>01.02.2024</td><td><a href='event.aspx?EventId=one'></a> Тип в ячейке <a href='event.aspx?EventId=two'>x</a></td></tr>"
    assert [(r["event_id"], r["event_type"], r["url"]) for r in feeds.message_rows(f"<table>{row}</table>", "https://h.ru/a/b")] == [("one", "Тип в ячейке x", "https://h.ru/a/event.aspx?EventId=one")]
    far = "<div>03.03.2023 <div><div><div><div><div><div><a href='/event/abc'>t</a></div></div></div></div></div></div></div>"
    near = "<div>03.03.2023 <div><div><a href='/event/abc'>t</a></div></div></div>"
    assert [r["published_at"] for r in feeds.message_rows(far) + feeds.message_rows(near)] == [None, datetime(2023, 3, 3)]
    listed = "<a href='/event/outside'>x</a><div id='searchResults'><li><a href='/event/inside'>y</a></li></div>"
    assert [r["event_id"] for r in feeds.message_rows(listed, only_results=True)] == ["inside"] and len(feeds.message_rows(listed)) == 2
    assert [r["event_id"] for r in feeds.search_results(listed)] == ["inside"] and [r["event_id"] for r in feeds.search_results("<a href='/event/abc'>t</a>")] == ["abc"]
    page = feeds.event_page("<h1>T</h1><script>x</script><body>Эмитент: АО Р<br>Опубликовано: 05.06.2023 11:12<a href='/e?EventId=Q-1'>e</a></body>")
    assert page["published_at"] == datetime(2023, 6, 5, 11, 12) and page["company_name"] == "АО Р" and page["event_id"] == "Q-1"
    page = feeds.event_page("<title>T</title><nav>Эмитент: нет</nav><div class='eventText'>" + "слово " * 60 + "<br>Тип сообщения: О рейтинге<br>Размещено 01.01.2020</div><p>Тип события: не здесь</p><link rel='canonical' href='/e?EventId=C-2'>")
    assert page["event_type"] == "О рейтинге" and page["title"] == "T" and page["event_id"] == "C-2" and "нет" not in page["body_text"] and "не здесь" not in page["body_text"]


def test_search_answers(spark):
    answers = {
        '{"events": [], "items": [{"guid": "a", "company_id": 5, "orgName": " ОАО <b>Х</b> ", "title": "<i>Тип</i>", "someDate": "2024-05-06T07:08"}], "total": 3}': [("a", 5, "ОАО <b>Х</b>", datetime(2024, 5, 6, 7, 8), "Тип")],
        '{"n": 4, "odd": [{"Name": "t", "x": "abcdefghijklmnop-1"}], "totalCount": "17"}': [("abcdefghijklmnop-1", None, "", None, "t")],
        '[{"code": 7, "dt": "01.02.2020 10:11", "companyID": "x"}]': [("7", None, "", datetime(2020, 2, 1, 10, 11), "")],
        '{"data": [1, 2], "list": []}': [], "not json": [],
    }
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, payload string")
    for k, want in enumerate(answers.values()):
        got = feeds.search_json(df.filter(F.col("k") == k)).collect()
        assert [(r.event_id, r.company_id, r.event_type, r.published_at) for r in got] == [(e, c, t, d) for e, c, _, d, t in want], k
        assert all(r.url == f"https://e-disclosure.ru/portal/event.aspx?EventId={r.event_id}" for r in got)
    assert [r.t for r in df.select("k", feeds.search_total(F.col("payload")).alias("t")).orderBy("k").collect()] == [3, 17, None, None, None]


def test_pages_of_history(spark):
    """Pages join up to the cursor's total; without a cursor a short page ends the list."""
    import json

    page = lambda rows, cursor=None: json.dumps({"history": {"columns": ["TRADEDATE", "SECID", "CLOSE"], "data": rows}} | ({"history.cursor": {"columns": ["INDEX", "TOTAL", "PAGESIZE"], "data": [cursor]}} if cursor else {}))
    row = lambda k: [f"2024-01-{k % 28 + 1:02d}", f"S{k}", 1.0 + k]
    with_cursor = [("a", 0, page([row(1), row(2)], [0, 3, 2])), ("a", 2, page([row(3)], [2, 3, 2])), ("a", 4, page([row(4)], [4, 3, 2]))]
    without = [("b", 0, page([row(k) for k in range(100)])), ("b", 100, page([row(k) for k in range(100, 107)])), ("b", 107, page([row(200)]))]
    hole = [("c", 0, page([row(k) for k in range(100)])), ("c", 100, page([])), ("c", 200, page([row(7)]))]
    df = spark.createDataFrame(with_cursor + without + hole, "list string, start long, payload string").repartition(3)
    got = feeds.listed_pages(df, "history", key="list")
    assert sorted((r.list, r.start) for r in got.collect()) == [("a", 0), ("a", 2), ("b", 0), ("b", 100), ("c", 0)]
    assert feeds.json_block(got.filter("list = 'a'"), "history", {"SECID": "string"}).count() == 3


def test_bodies_and_totals(spark):
    bodies = [("тест".encode("cp1251"), None), ("тест".encode(), "ISO-8859-1"), ("тест".encode("cp1251"), "windows-1251"), ("тест".encode(), "no-such"), (b"abc", None), (None, None), (b"\xd0\xff", None)]
    df = spark.createDataFrame([(k, b, e) for k, (b, e) in enumerate(bodies)], "k int, body binary, encoding string")
    got = [r.t for r in feeds.decoded(df).orderBy("k").select(F.col("decoded").alias("t")).collect()]
    assert got == ["тест", "тест", "тест", "тест", "abc", None, "\ufffd\ufffd"]
    cases = {"<p>Страница 2 из 15</p>": 15, "<b>Стр. 1 / 7</b>": 7, "Найдено записей: 1 234": 1234, "ничего": None, "": None, None: None}
    assert one(spark, list(cases), feeds.total_pages) == list(cases.values())


def test_request_keys(spark):
    import hashlib

    df = spark.createDataFrame([("get", "http://x/y", {"b": ["2", "3"], "a": ["1"]}, None), ("POST", "http://x/ы", None, {"k": ["v"]}), ("GET", "u", None, None)], "m string, u string, p map<string,array<string>>, d map<string,array<string>>")
    got = [r.k for r in df.select(feeds.cache_key(F.col("m"), F.col("u"), F.col("p"), F.col("d")).alias("k")).collect()]
    assert got == [hashlib.sha1(x.encode()).hexdigest() for x in ("GET http://x/y?a=1&b=2|3#", "POST http://x/ы?#k=v", "GET u?#")]


def test_page_classes(spark):
    cases = {
        "<p>text</p>": "content", "": "content", None: "content", "a captcha is mentioned": "content", "<script src='sp_rotated_captcha.js'>": "captcha", '<script>{"is_captcha": true}</script>': "captcha",
        "<div id='id_spinner'></div>": "stub", "<DIV ID='spinner-container'>": "stub", '<meta http-equiv="refresh"><noscript>x</noscript><script>y</script>': "stub", '<meta http-equiv="refresh"><noscript>x</noscript><script>y</script><a href="#">z</a>': "content",
        "x" * 70_000 + "captchaintgen": "content",
    }
    assert one(spark, list(cases), feeds.page_class) == list(cases.values())


def test_functions_in_sql(spark):
    from tapeline.functions import registry

    assert len(registry.register(spark)) == 10
    texts = ["7707083893.0", "123", "0,0012 %", "1\u00a0234,5", "Генеральный директор", "И.о. генерального директора", "член Совета директоров", "Об изменении размера доли участия члена органа управления эмитента", "Дефолт", "доля до изменения, после изменения", "it's", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    df.createOrReplaceTempView("texts")
    sql = spark.sql("SELECT k, normalize_inn(x) AS a, parse_number(x) AS b, title_category(x) AS c, classify_role(x) AS d, is_stake_text(x) AS e FROM texts")
    x = F.col("x")
    own = df.select("k", text.normalize_inn(x).alias("a"), text.parse_number(x).alias("b"), text.classify(x).alias("c"), text.classify_role(x).alias("d"), text.is_stake_text(x).alias("e"))
    assert sorted(sql.collect()) == sorted(own.collect(), key=lambda r: r.k)
    bodies = spark.createDataFrame([(k, t) for k, t in enumerate([STAKES[0][0], "1. Один 2. Два\r\n \u00a0 \n2.1. Три 3.5 раза", "", None])], "k int, body string")
    bodies.createOrReplaceTempView("bodies")
    told = {r.k: r.c for r in bodies.select("k", text.split_clauses(F.col("body")).alias("c")).collect()}
    assert {r.k: r.c for r in spark.sql("SELECT k, split_clauses(body) AS c FROM bodies").collect()} == told and len(told[0]) == 5 and told[3] == []
    by_row = spark.sql("SELECT k, at, clause FROM bodies, LATERAL clauses(body)").collect()
    assert sorted((r.k, r.at, r.clause) for r in by_row) == [(k, i + 1, c) for k in sorted(told) for i, c in enumerate(told[k])]
    page = "<h1>T</h1><a href='/portal/company.aspx?id=7'>ПАО</a><a href='/event/abc'>О дивидендах</a>"
    assert spark.sql("SELECT parse_event_page(:p).company_id AS c, parse_company_page(:p).name AS n", {"p": page}).first()[:] == (7, "T")
    assert [r.event_id for r in spark.sql("SELECT * FROM parse_message_list(:p)", {"p": page}).collect()] == ["abc"]


def test_answers_live_for_a_while(spark):
    """The newest good answer before a request, within its time to live; captchas and empty bodies are never kept."""
    at = lambda h, m=0: datetime(2024, 1, 1 + h // 24, h % 24, m)
    answers = spark.createDataFrame([("a", at(0), "one"), ("a", at(3), "two"), ("a", at(4), "<script src=captchaintgen>"), ("a", at(5), ""), ("a", at(40), "late"), ("b", at(9), "b"), (None, at(0), "x")], "key string, landed_at timestamp, body string")
    asked = [(1, "a", at(2)), (2, "a", at(3)), (3, "a", at(6)), (4, "a", at(8, 59)), (5, "a", at(9)), (6, "b", at(8)), (7, "c", at(9)), (8, "a", at(46)), (9, None, at(1))]
    got = feeds.cached_answers(spark.createDataFrame(asked, "id long, key string, asked_at timestamp"), answers, 6 * 3600).collect()
    assert {r.id: r.body for r in got} == {1: "one", 2: "two", 3: "two", 4: "two", 5: None, 6: None, 7: None, 8: None, 9: None}
    assert {r.id: r.landed_at for r in got}[3] == at(3)
