import pytest

from pyspark.sql import functions as F

from aidlens.operators import questions, reports, triage
from aidlens.operators.questions import BLOCK
from samples import REQUEST_COLUMNS, REQUESTS

CASES = {
    "Assam mein baadh aayi hai?": ("flood", ["baadh"]),
    "flooding": ("flood", ["flooding", "flood"]),
    "What about blood?": ("heat", ["loo"]),
    "disease and drought": ("health", ["disease"]),
    "A flood warning": ("flood", ["flood"]),
    "": ("general", []),
    "ﬂood": ("flood", ["flood"]),
    "ſeismic": ("earthquake", ["seismic"]),
    "STORM SURGE": ("cyclone", ["storm surge"]),
}


def test_classification(rows):
    df = rows([(q,) for q in CASES], "text string")
    got = {r.text: (r.domain, r.matched_terms) for r in questions.classify(df).collect()}
    assert got == CASES
    labels = {r.domain: r.label for r in questions.classify(df).collect()}
    assert labels["general"] == "world issue" and labels["flood"] == "flood"


ROUTES = {
    "tremor last night": "earthquake",
    "need medicine": "resource",
    "drought": "domain_unconnected",
    "risk in europe": "global_scan",
    "assam baadh": "assam_flood",
    "river overflow": "flood",
    "heat": "weather",
    "how": "capability",
    "mudslide": "domain_report",
    "hello": "default",
}


def test_routes(rows):
    got = {r.text: r for r in questions.answer_routes(rows([(q,) for q in ROUTES], "text string")).collect()}
    assert {q: r.route for q, r in got.items()} == ROUTES
    assert got["drought"].sub_domain == "economy, markets, and supply chains"
    assert got["hello"].sub_domain is None


def test_sub_domains_and_flags(rows):
    df = rows([("epidemic after war",), ("warning, people died",), ("An alert in INDIA",)], "text string")
    got = {r.text: r for r in questions.answer_routes(df).collect()}
    assert got["epidemic after war"].sub_domain == "public health"
    assert got["warning, people died"].sub_domain == "conflict and violence"
    assert got["warning, people died"].death_requested
    flags = {r.text: r.f for r in df.select("text", questions.refresh_trigger("text").alias("f")).collect()}
    assert flags == {"epidemic after war": False, "warning, people died": False, "An alert in INDIA": True}


def plain_history(messages, depth=8):
    out = {}
    for c in {m[0] for m in messages}:
        mine = sorted(m for m in messages if m[0] == c)
        for i, m in enumerate(mine):
            out[m[0], m[1]] = "\n".join(f"{x[2].upper()}: {x[3]}" for x in mine[max(0, i - depth):i])
    return out


MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def test_history_keeps_eight(rows):
    data = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(12)] + [(2, 5, "user", "alone")]
    got = {(r.conv_id, r.turn): r.history for r in questions.conversation_context(rows(data, MESSAGES)).collect()}
    assert got == plain_history(data)


def test_history_across_blocks_and_gaps(spark):
    """One long conversation with gaps in its turn numbers, cut into several blocks."""
    turns = sorted({*range(0, 2 * BLOCK + 50), *range(5 * BLOCK, 9 * BLOCK, 7), 40 * BLOCK})
    data = [(1, t, "user", f"m{t}") for t in turns]
    got = {(r.conv_id, r.turn): r.history for r in questions.conversation_context(spark.createDataFrame(data, MESSAGES)).collect()}
    assert got == plain_history(data)
    numbered = questions.number_messages(spark.createDataFrame(data, MESSAGES)).orderBy("turn").collect()
    assert [r.pos for r in numbered] == list(range(len(turns)))


def test_routing_text_inherits_history(rows):
    data = [(1, 0, "user", "earthquake?"), (1, 1, "assistant", "yes"), (1, 2, "user", "and deaths?")]
    df = rows(data, MESSAGES)
    texts = {r.turn: r.routing_text for r in questions.routing_text(df).collect()}
    assert texts[0] == "earthquake?"
    assert texts[2] == "Previous conversation:\nUSER: earthquake?\nASSISTANT: yes\n\nCurrent user message: and deaths?"
    routed = {r.turn: r.route for r in questions.answer_routes(questions.routing_text(df), "routing_text").collect()}
    assert routed[2] == "earthquake"
    alone = questions.routing_text(df, use_history=False)
    assert {r.turn: r.route for r in questions.answer_routes(alone, "routing_text").collect()}[2] == "default"


def test_transcripts(rows):
    data = [(1, t, "user", f"m{t}") for t in range(5)]
    df = rows(data, MESSAGES)
    assert questions.conversation_transcript(df).first().transcript == "\n\n".join(f"User: m{t}" for t in range(5))
    parts = questions.conversation_transcript(df, part_messages=2).orderBy("part").collect()
    assert "\n\n".join(p.transcript for p in parts) == "\n\n".join(f"User: m{t}" for t in range(5))
    known = rows([(1,), (9,)], "conv_id bigint")
    exported = {r.conv_id: r.transcript for r in questions.exported_transcripts(known, df).collect()}
    assert exported[9] == "No messages yet."
    assert {r.conv_id: r.messages for r in questions.conversation_counts(df).collect()} == {1: 5}


def test_titles(rows):
    df = rows([(1, 0, "user", "x" * 60), (2, 0, "user", "y" * 52), (2, 1, "user", "z")], MESSAGES)
    got = {r.conv_id: r.title for r in questions.conversation_titles(df).collect()}
    assert got == {1: "x" * 52 + "…", 2: "y" * 52}


def test_attachments(rows):
    df = rows([("text/plain", "a" * 13000), ("application/pdf", "a")], "mime string, content string")
    got = {r.mime: r.e for r in df.select("mime", questions.document_excerpt(df.mime, df.content).alias("e")).collect()}
    assert got["text/plain"] == "a" * 12000 and got["application/pdf"].startswith("Binary document")
    labels = rows([(None, None), (None, "rear"), ("f.pdf", "rear")], "d string, c string")
    shown = sorted(r.x for r in labels.select(questions.attachment_label(labels.d, labels.c).alias("x")).collect())
    assert shown == ["No attachment", "f.pdf", "rear"]


def test_situation_report_keeps_unknowns(rows):
    df = rows([("q?", "heat", "nan", 0)], "question string, label string, location string, deaths int")
    r = reports.situation_report(df).first()
    assert (r.problem_type, r.location, r.deaths) == ("Heat", "Not reported by the connected source", "0")
    assert r.injuries == r.affected_people == "Not reported by the connected source"
    assert r.sources == "No source link attached yet"
    assert "| Deaths | 0 |" in r.report and "| Injuries | Not reported by the connected source |" in r.report
    assert r.report.startswith("### Heat situation report")


def test_report_lists(rows):
    schema = "question string, label string, affected_areas array<string>, source_links array<struct<name:string,url:string>>"
    r = reports.situation_report(rows([("q", "flood", ["A", "B"], [("N", "u"), ("M", "v")])], schema)).first()
    assert r.affected_areas == "A, B" and r.sources == "[N](u) · [M](v)"


def test_answers_quote_figures(rows, spark):
    asked = questions.answer_routes(rows([(1, "food shortage, who died?"), (2, "tremor")], "qid int, text string"))
    kpis = triage.request_kpis(rows(REQUESTS, REQUEST_COLUMNS))
    answer = reports.resource_answer(asked, kpis).collect()
    assert len(answer) == 1 and "**4 critical request(s)**, **13 open request(s)**, and **2,355 affected people**" in answer[0].answer
    none = spark.sql("SELECT 0 AS events, cast(NULL AS double) AS peak_severity, cast(NULL AS string) AS peak_place")
    text = reports.hazard_answer(asked, none).first().answer
    assert "contains **0 event(s)** in the last seven days" in text
    assert "The highest-magnitude event in the retrieved set is **not available** near **not available**." in text
    assert "\n\n**Deaths/casualties:** Not provided by this hazard feed.\n\n" in text


def test_answers_end_with_their_evidence(rows):
    answers = rows([(1, "A.", "notes.txt", "first line"), (2, "B.", None, None), (3, "C.", "empty.txt", None)], "qid int, answer string, name string, excerpt string")
    contexts = rows([(1, '[{"event":"x"}]', 1), (3, "[]", 1)], "qid int, context string, matches int")
    end = "These records are source-linked observations. They do not override newer official bulletins, and missing casualty fields remain **Not reported**."
    got = {r.qid: r.answer for r in reports.with_evidence(answers, contexts, ["qid"], ("name", "excerpt")).collect()}
    assert got == {
        1: f'A.\n\n### Retrieved evidence records\n\n[{{"event":"x"}}]\n\nAttached document: notes.txt\nfirst line\n\n{end}',
        2: "B.\n\n### Evidence store status\n\nNo matching saved official evidence record was found for this wording. "
        "Enable **Refresh official India evidence** and ask with a location, event type, and time period.",
        3: f"C.\n\n### Retrieved evidence records\n\n[]\n\nAttached document: empty.txt\n\n\n{end}",
    }
    plain = {r.qid: r.answer for r in reports.with_evidence(answers, contexts, ["qid"]).collect()}
    assert plain[1] == f'A.\n\n### Retrieved evidence records\n\n[{{"event":"x"}}]\n\n{end}'


def test_reports_of_both_routes_word_for_word(rows):
    asked = rows([("q1", "flood", "flood", "flood"), ("q2", "cyclone", "cyclone", "domain_report"), ("q3", "general", "world issue", "help")],
                 "text string, domain string, label string, route string")
    got = {r.question: r for r in reports.situation_report(reports.report_inputs(asked)).collect()}
    assert set(got) == {"q1", "q2"}
    assert got["q1"].evidence_status == "Disaster domain recognized; connect the current official bulletin before treating the report as live"
    assert got["q1"].confidence == "Low without a named location and current impact bulletin"
    assert got["q2"].evidence_status == "Domain recognized; source adapter required for live impact figures"
    assert got["q2"].confidence == "Low until a current source record is attached"
    assert "**What may be happening:** The agent has identified this as a cyclone question. It should combine hazard observations" in got["q2"].report
    assert "**Recommended response workflow:** Confirm the exact city, district, block, or village; check the newest" in got["q2"].report
    assert got["q2"].report.endswith(
        "**Limitations:** The agent will not invent affected people, deaths, injuries, or responders. "
        "Add a location and time range for a source-bounded answer."
    )


def test_white_space_of_any_kind_is_blank(rows):
    from aidlens.functions import text

    df = rows([("\t",), (" \u00a0\n",), (" x ",)], "v string").select(text.display_value(F.col("v")).alias("s"))
    assert sorted(r.s for r in df.collect()) == [" x ", "Not reported by the connected source", "Not reported by the connected source"]
