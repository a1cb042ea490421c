"""Course and assignment payloads of three learning platforms in one schema.

Each input has one JSON document per row in ``payload``; the vendor shapes are described by
explicit schemas so that nothing is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload shapes by vendor.
COURSE_SCHEMAS = {
    "canvas": "id string, name string, course_code string, term struct<name:string>, start_at string, end_at string",
    "blackboard": (
        "id string, name string, courseId string, termId string, "
        "availability struct<available:struct<from:string,until:string>>"
    ),
    "moodle": "id string, fullname string, shortname string, category string, startdate long, enddate long",
}
ASSIGNMENT_SCHEMAS = {
    "canvas": (
        "id string, name string, description string, due_at string, points_possible double, "
        "submission_types array<string>"
    ),
    "blackboard": (
        "id string, name string, description string, dueDate string, score struct<possible:double>, "
        "contentHandler struct<id:string>"
    ),
    "moodle": (
        "courses array<struct<id:string, assignments:array<struct<id:string, name:string, intro:string, "
        "duedate:long, grade:double>>>>"
    ),
}
BLACKBOARD_ASSIGNMENT = "resource/x-bb-assignment"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _iso(value: Column) -> Column:
    return F.try_to_timestamp(value)


def _epoch(value: Column) -> Column:
    """Seconds since the epoch; 0 and null both mean that no date was set."""
    return F.when(value != 0, F.timestamp_seconds(value))


def _course(vendor: str, id_, name, code, term, start, end) -> list[Column]:
    return [
        F.lit(vendor).alias("vendor"), id_.alias("course_id"), name.alias("name"), _text(code).alias("code"),
        _text(term).alias("term"), start.alias("start_at"), end.alias("end_at"),
    ]


def courses(canvas: DataFrame, blackboard: DataFrame, moodle: DataFrame) -> DataFrame:
    """One course per row from the three vendors' payloads."""
    def parsed(df: DataFrame, vendor: str) -> DataFrame:
        return df.select(F.from_json("payload", COURSE_SCHEMAS[vendor]).alias("p")).filter("p.id is not null")

    c, p = parsed(canvas, "canvas"), F.col
    canvas_rows = c.select(*_course("canvas", p("p.id"), p("p.name"), p("p.course_code"), p("p.term.name"),
                                    _iso(p("p.start_at")), _iso(p("p.end_at"))))
    blackboard_rows = parsed(blackboard, "blackboard").select(
        *_course("blackboard", p("p.id"), p("p.name"), p("p.courseId"), p("p.termId"),
                 _iso(p("p.availability.available.from")), _iso(p("p.availability.available.until"))))
    moodle_rows = parsed(moodle, "moodle").select(
        *_course("moodle", p("p.id"), p("p.fullname"), p("p.shortname"), p("p.category"),
                 _epoch(p("p.startdate")), _epoch(p("p.enddate"))))
    return canvas_rows.unionByName(blackboard_rows).unionByName(moodle_rows)


def _assignment(vendor: str, course, id_, name, description, due, points, kinds) -> list[Column]:
    return [
        F.lit(vendor).alias("vendor"), course.alias("course_id"), id_.alias("assignment_id"), name.alias("name"),
        _text(description).alias("description"), due.alias("due_at"),
        F.coalesce(points, F.lit(0.0)).alias("points_possible"), kinds.alias("submission_types"),
    ]


def assignments(canvas: DataFrame, blackboard: DataFrame, moodle: DataFrame) -> DataFrame:
    """One assignment per row; inputs carry ``course_id`` beside ``payload``.

    Blackboard rows that are not assignments are dropped. A Moodle payload nests assignments
    under its first course.
    """
    def parsed(df: DataFrame, vendor: str) -> DataFrame:
        return df.select("course_id", F.from_json("payload", ASSIGNMENT_SCHEMAS[vendor]).alias("p"))

    p = F.col
    canvas_rows = parsed(canvas, "canvas").select(
        *_assignment("canvas", p("course_id"), p("p.id"), p("p.name"), p("p.description"), _iso(p("p.due_at")),
                     p("p.points_possible"), F.coalesce(p("p.submission_types"), F.array().cast("array<string>"))))
    blackboard_rows = parsed(blackboard, "blackboard").filter(
        p("p.contentHandler.id") == BLACKBOARD_ASSIGNMENT
    ).select(
        *_assignment("blackboard", p("course_id"), p("p.id"), p("p.name"), p("p.description"), _iso(p("p.dueDate")),
                     p("p.score.possible"), F.array(F.lit("online_text_entry"))))
    nested = parsed(moodle, "moodle").select("course_id", F.explode(F.get("p.courses", F.lit(0))["assignments"]).alias("a"))
    moodle_rows = nested.select(
        *_assignment("moodle", p("course_id"), p("a.id"), p("a.name"), p("a.intro"), _epoch(p("a.duedate")),
                     p("a.grade"), F.array(F.lit("online_text"))))
    return canvas_rows.unionByName(blackboard_rows).unionByName(moodle_rows)
