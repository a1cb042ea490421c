"""Pieces of SQL shared by the check queries."""

WS = r"\s\p{Z}\x{85}\x0b"


def raw_words(text: str = "text") -> str:
    return f"regexp_extract_all({text}, '[^{WS}]+')"


def words(text: str = "text") -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def letters(text: str = "text") -> str:
    return rf"regexp_extract_all(lower({text}), '\p{{L}}+')"


def sentences(text: str = "text") -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+'), "
        f"lambda s: regexp_replace(s, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda s: s <> '')"
    )


def occurrences(text: str, needle: str) -> str:
    quoted = needle.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{quoted}', ''))) // {len(needle)})"


def phrases(text: str, items: list[str]) -> str:
    return "(" + " + ".join(occurrences(f"lower({text})", p) for p in items) + ")"


def in_list(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def values(rows: list[tuple], columns: str) -> str:
    """An inline table; strings are quoted, numbers are not."""
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({columns})"


def member_count(tokens: str, items: list[str]) -> str:
    return f"len(list_filter({tokens}, lambda w: w IN {in_list(items)}))"


# Word frequencies of each document: (doc_id, word, n) for a token list expression.
def frequencies(tokens: str, table: str = "documents", key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, word, count(*) AS n FROM (SELECT {key}, unnest({tokens}) AS word FROM {table}) "
        f"GROUP BY {key}, word"
    )
