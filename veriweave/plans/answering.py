"""Answers to a table of questions.

Questions are classified once and split by what they ask. Each branch is one join
over all its questions. Answers: question_id, part_no, response_type, found,
answer, and for short answers ``data`` as JSON. The parts of an answer, in order,
are its text; only lists of very many people, of a case or of a name, need more than one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.functions.groups import PART_ROWS, list_in_parts, measured_groups, top_per_key
from veriweave.operators import answers, lookups, motifs, questions
from veriweave.session import staged
from veriweave.sources.metadata import coerce_values, union_all

Tables = Mapping[str, DataFrame]

_CASE_KINDS = ("case_id", "case_number", "crime_number")
_CASE_SUBS = ("case_by_id", "case_by_number", "case_by_crime")
_KEY_NAMES = {"case_id": "CaseMasterID", "case_number": "CaseNo", "crime_number": "CrimeNo",
              "officer_id": "EmployeeID", "victim_id": "VictimMasterID", "accused_id": "AccusedMasterID"}
UNIDENTIFIED = (
    "I couldn't identify which case or person you are asking about. Please include a CaseNo, CrimeNo or ID."
)


def _row(rows: DataFrame, kind: str | Column, found: Column, answer: Column, data: Column | None = None,
         part: Column | None = None) -> DataFrame:
    return rows.select(
        "question_id",
        (F.lit(0).cast("bigint") if part is None else part).alias("part_no"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("response_type"),
        found.alias("found"),
        answer.alias("answer"),
        (F.lit(None).cast("string") if data is None else F.to_json(data)).alias("data"),
    )


def plan(detected: DataFrame) -> DataFrame:
    """Add the branch that answers each question."""
    sub, kind = F.col("sub_intent"), F.col("identifier_kind")
    known = kind.isNotNull()
    branch = (
        F.when(sub == "similar_cases", "semantic_search")
        .when(sub == "relationship", "relationship")
        .when(~known, "unidentified")
        .when(sub.isin(*_CASE_SUBS), "case_details")
        .otherwise(sub)
    )
    return detected.withColumn("branch", branch)


def _rejected(rows: DataFrame) -> DataFrame:
    """Answers to questions whose identifier does not fit its column."""
    name = F.lit("")
    for kind, column in _KEY_NAMES.items():
        name = F.when(F.col("identifier_kind") == kind, F.lit(column)).otherwise(name)
    message = F.concat(F.lit("'"), F.col("identifier_value"), F.lit("' is not a valid numeric "), name, F.lit("."))
    return _row(rows, "answer", F.lit(False), message)


def _list_answer(asked: DataFrame, people: DataFrame, key: str, line: Column, role: str, part_rows: int) -> DataFrame:
    """Numbered lists of the people of each asked case."""
    label = answers.found_label()
    members = people.join(asked.select("case_id"), "case_id", "left_semi").select(
        "case_id", F.col(key).alias("member"), line.alias("entry")
    )
    large, n_rows = measured_groups(members, ["case_id"], "member", part_rows)
    parts = list_in_parts(members, ["case_id"], "member", "entry", "\n", large, part_rows, numbered=True, rows=n_rows)
    per_case = Window.partitionBy("case_id")
    parts = parts.withColumns({
        "total": F.sum("members").over(per_case),
        "nth": F.row_number().over(per_case.orderBy("part")).cast("bigint") - 1,
    })
    rows = asked.join(parts, "case_id", "left")
    noun = "victim(s)" if role == "victim" else "accused"
    none = F.concat(F.lit("There are no victims listed for " if role == "victim" else "There are no accused listed for "),
                    label, F.lit("."))
    head = F.concat(F.lit("Found "), F.col("total").cast("string"), F.lit(f" {noun} for "), label, F.lit(":"))
    text = F.when(F.col("total").isNull(), none).otherwise(
        F.concat(F.when(F.col("nth") == 0, head).otherwise(F.lit("")), F.lit("\n"), F.col("text"))
    )
    found = F.col("total").isNotNull()
    data = F.struct(F.lit(role).alias("role"), F.col("total").alias("total"), answers.case_payload().alias("case"))
    kind = F.when(found, F.lit("person_details")).otherwise(F.lit("answer"))
    return _row(rows, kind, found, text, F.when(found & (F.col("nth") == 0), data), F.coalesce("nth", F.lit(0)))


def answer_questions(
    asked: DataFrame, t: Tables, similar: DataFrame | None = None, part_rows: int = PART_ROWS, by_name: int | None = None
) -> DataFrame:
    """Answer every question.

    ``asked``: question_id, text and, where there is a conversation, history_case.
    ``similar`` has the search results for questions that ask for similar cases. A name is
    answered with all people of that name, or with the first ``by_name`` where that is given.
    """
    detected = questions.detect_intent(asked, "text")
    if "history_case" in asked.columns:
        detected = questions.fill_from_history(detected)
    planned = plan(detected).select("question_id", "sub_intent", "branch", "identifier_kind", "identifier_value")
    # Every branch below reads the classified questions, and those on cases the found cases. Keys of people are
    # read from the identifier here, so that what is left of a filter on the branch are the keys themselves.
    planned = staged(coerce_values(planned, "identifier_value", "bigint", "key_value"), "questions")
    parts = []

    # Case-scoped questions all start from the case.
    scoped = planned.filter(F.col("identifier_kind").isin(*_CASE_KINDS) & ~F.col("branch").isin("semantic_search", "relationship"))
    # The three keys of a case are whole numbers; a text that is none is told back.
    case_types = dict(lookups.cases(t).dtypes)
    fits = F.lit(False)
    for kind in _CASE_KINDS:
        numeric = case_types[kind] in ("int", "bigint")
        ok = F.col("identifier_value").rlike(r"^-*[0-9]+$") if numeric else F.lit(True)
        fits = fits | ((F.col("identifier_kind") == kind) & ok)
    parts.append(_rejected(scoped.filter(~fits)))
    references = scoped.filter(fits).select(
        F.col("question_id").alias("ref_id"), F.col("identifier_kind").alias("kind"),
        F.col("identifier_value").alias("value"), "sub_intent", "branch",
    )
    found = staged(lookups.find_cases(references, t).withColumnRenamed("ref_id", "question_id"), "cases")
    label = answers.case_label(F.col("kind"), F.col("value"))
    missing = F.concat(F.lit("No case was found for "), label, F.lit("."))
    parts.append(_row(found.filter("NOT found"), "answer", F.lit(False), missing))
    hit = found.filter("found")

    def branch(name: str) -> DataFrame:
        return hit.filter(F.col("branch") == name)

    case_data = F.struct(answers.case_payload().alias("case"))
    parts.append(_row(branch("case_details"), "case_details", F.lit(True), answers.case_details(), case_data))
    parts.append(_row(branch("status_for_case"), "case_details", F.lit(True), answers.case_status(), case_data))
    parts.append(_officer_branch(branch("officer_for_case"), t, label))
    people = ((lookups.victims(t), "victim_id", answers.person_line(), "victim"),
              (lookups.accused(t), "accused_id", answers.accused_line(), "accused"))
    for rows, key, line, role in people:
        parts.append(_list_answer(branch(f"{role}_for_case"), rows, key, line, role, part_rows))
    sheets = lookups.chargesheet_status(
        branch("chargesheet_for_case").withColumn("key_value", F.col("case_id")), t
    )
    sheet_data = F.struct(answers.case_payload().alias("case"), F.struct("filed", "date", "court_name").alias("chargesheet"))
    parts.append(_row(sheets, "case_details", F.lit(True), answers.chargesheet_answer(answers.found_label()), sheet_data))
    parts += _reasoning_branches(hit, t, part_rows)

    # People by id or name.
    for role, find in (("officer", lookups.find_officers), ("victim", lookups.find_victims), ("accused", lookups.find_accused)):
        parts += _entity_branch(planned.filter(F.col("branch") == role), role, find, t)
    parts.append(_name_branch(planned.filter(F.col("branch") == "accused_by_name"), t, part_rows, by_name))

    parts.append(_row(planned.filter(F.col("branch") == "unidentified"), "answer", F.lit(False), F.lit(UNIDENTIFIED)))
    parts.append(_row(planned.filter(F.col("branch") == "relationship"), "context", F.lit(False),
                      F.lit("No specific context could be retrieved for this query.")))
    searched = planned.filter(F.col("branch") == "semantic_search")
    if similar is None:
        parts.append(_row(searched, "context", F.lit(False), F.lit("No specific context could be retrieved for this query.")))
    else:
        listed = searched.join(similar.withColumnRenamed("query_id", "question_id"), "question_id")
        data = F.struct("document_id", "document_type", "similarity_score", "final_score", "text_preview")
        parts.append(_row(listed, "context", F.lit(True), F.to_json(data), None, F.col("rank") - 1))
        parts.append(_row(searched.join(listed.select("question_id"), "question_id", "left_anti"), "context",
                          F.lit(False), F.lit("No specific context could be retrieved for this query.")))
    return union_all(parts)


def _officer_branch(rows: DataFrame, t: Tables, label: Column) -> DataFrame:
    staff = lookups.officers(t).withColumnRenamed("employee_id", "police_person_id").withColumn("_hit", F.lit(True))
    joined = rows.join(staff, "police_person_id", "left")
    # The label of a resolved case follows the identifier that was asked for.
    none = F.concat(F.lit("No investigating officer is recorded for "), label, F.lit("."))
    lost = F.concat(label, F.lit(" references PolicePersonID "), F.col("police_person_id").cast("string"),
                    F.lit(", but no matching Employee record was found."))
    known = F.coalesce("_hit", F.lit(False))
    text = (
        F.when(F.col("police_person_id").isNull(), none).when(~known, lost)
        .otherwise(answers.officer_of_case(answers.found_label()))
    )
    officer = F.struct(F.col("police_person_id").alias("employee_id"), "first_name", "kgid", "designation", "rank")
    data = F.when(known, F.struct(officer.alias("officer"), answers.case_payload().alias("case")))
    kind = F.when(known, F.lit("officer_details")).otherwise(F.lit("answer"))
    return _row(joined, kind, known, text, data)


def _reasoning_branches(hit: DataFrame, t: Tables, part_rows: int) -> list[DataFrame]:
    """Context of questions that need reasoning: summary, network, co-accused, timeline, a row per block or record."""
    out = []
    summary = hit.filter(F.col("branch") == "summarize_case")
    blocks = lookups.case_context(summary.select("case_id"), t, part_rows)
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("section", "part")).cast("bigint") - 1
    told = summary.join(blocks, "case_id").withColumn("_no", order)
    lead = F.when(F.col("_no") == 0, F.lit("### Case Summary\n")).otherwise(F.lit("\n"))
    out.append(_row(told, "context", F.lit(True), F.concat(lead, F.col("block")), None, F.col("_no")))
    graph = (
        ("case_network", motifs.case_network, ("role", "member_id", "member_name")),
        ("co_accused", motifs.accused_of_case, ("accused_id", "name", "age", "gender")),
        ("case_timeline", motifs.case_timeline, ("event_date", "event_type", "event_id")),
    )
    for name, find, fields in graph:
        asked = hit.filter(F.col("branch") == name)
        found = asked.select("question_id", "case_id").join(find(asked.select("case_id").distinct(), t), "case_id")
        record = F.to_json(F.struct(*fields))
        # Each record is a row of its own; its hash gives it a place without ordering a whole case.
        out.append(_row(found, "context", F.lit(True), record, None, F.abs(F.xxhash64(record))))
        empty = asked.join(found.select("question_id").distinct(), "question_id", "left_anti")
        out.append(_row(empty, "context", F.lit(True), F.concat(F.lit("### Case\n"), F.to_json(answers.case_payload()))))
    return out


def _entity_branch(rows: DataFrame, role: str, find, t: Tables) -> list[DataFrame]:
    found = find(rows.filter("is_valid"), t)
    key = {"officer": "EmployeeID", "victim": "VictimMasterID", "accused": "AccusedMasterID"}[role]
    own = {"officer": "employee_id", "victim": "victim_id", "accused": "accused_id"}[role]
    found = found.withColumn(own, F.col("key_value"))
    details = answers.officer_details() if role == "officer" else answers.person_details(role)
    columns = {"officer": lookups.OFFICER_COLUMNS, "victim": lookups.VICTIM_COLUMNS, "accused": lookups.ACCUSED_COLUMNS}[role]
    missing = F.concat(F.lit(f"No {role} was found with {key} "), F.col("identifier_value"), F.lit("."))
    hit = found.filter("found")
    return [
        _row(hit, "officer_details" if role == "officer" else "person_details", F.lit(True), details,
             F.struct(F.lit(role).alias("role"), F.struct(*columns).alias("record"))),
        _row(found.filter("NOT found"), "answer", F.lit(False), missing),
        _rejected(rows.filter("NOT is_valid")),
    ]


def _name_branch(rows: DataFrame, t: Tables, part_rows: int, limit: int | None) -> DataFrame:
    asked, people = lookups.accused_named(rows.select(F.col("identifier_value").alias("name")).distinct(), t)
    order = lookups.BY_NAME_ORDER
    if limit is not None:
        people = top_per_key(people, ["_key"], [F.col(c) for c in order], limit, "position")
    # Counted, listed and asked for the first name of each.
    members = staged(people.select("_key", "name", *order, answers.match_line().alias("entry")), "named")
    large, n_rows = measured_groups(members, ["_key"], order[0], part_rows)
    parts = list_in_parts(members, ["_key"], order[0], "entry", "\n", large, part_rows, rows=n_rows, ties=order[1:])
    per_name = Window.partitionBy("_key")
    listed = parts.withColumns({
        "total": F.sum("members").over(per_name),
        "nth": F.row_number().over(per_name.orderBy("part")).cast("bigint") - 1,
        "n_parts": F.count(F.lit(1)).over(per_name),
    }).join(members.groupBy("_key").agg(F.min_by("name", F.struct(*order)).alias("name")), "_key")
    joined = rows.withColumn("asked", F.col("identifier_value")).join(asked, "asked", "left").join(listed, "_key", "left")
    head = F.when(F.col("nth") == 0, F.concat(
        F.lit("Found **"), F.col("total").cast("string"), F.lit("** accused record(s) for **"), F.col("name"),
        F.lit("**. A name is not a unique identity — each record below is a distinct entry:"),
    )).otherwise(F.lit(""))
    more = F.when(
        (F.col("total") > 1) & (F.col("nth") == F.col("n_parts") - 1), F.lit("\nSpecify a CaseMasterID, AccusedMasterID or PersonID to narrow this down.")
    ).otherwise(F.lit(""))
    none = F.concat(F.lit("No accused records were found for the name '"), F.col("asked"), F.lit("'."))
    known = F.col("total").isNotNull()
    data = F.struct(
        F.lit("accused").alias("entity"), F.col("asked").alias("query"), F.col("total").alias("total"),
        F.when(F.col("total") > 1, F.lit(answers.NAME_NOTE)).alias("note"),
    )
    kind = F.when(known, F.lit("search_results")).otherwise(F.lit("answer"))
    text = F.concat(head, F.lit("\n"), F.col("text"), more)
    return _row(joined, kind, known, F.when(known, text).otherwise(none), F.when(known & (F.col("nth") == 0), data), F.coalesce("nth", F.lit(0)))
