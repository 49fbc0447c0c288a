"""Small SQL fragments shared by the oracle queries."""

AS_OF_SQL = "DATE '2001-07-20'"

SCOPED = f"""scoped AS (
  SELECT rep_key AS rep_scope, * FROM sales WHERE sale_date < {AS_OF_SQL} AND rep_key IS NOT NULL
  UNION ALL
  SELECT 'ALL' AS rep_scope, * FROM sales WHERE sale_date < {AS_OF_SQL})"""

MONTH = "CAST(date_trunc('month', sale_date) AS DATE)"
WONF = "CASE WHEN outcome = 'won' THEN 1 ELSE 0 END"


def pct1(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN floor(({num} * 2000 + {den}) / ({den} * 2)) / 10 END"


def pct0(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST(floor(({num} * 200 + {den}) / ({den} * 2)) AS BIGINT) END"


def py_strip(expr: str) -> str:
    """Python's ``str.strip()``: ``trim`` over the same character set."""
    from dealerlens.operators.text import PY_WHITESPACE

    return f"trim({expr}, {' || '.join(f'chr({ord(c)})' for c in PY_WHITESPACE)})"


def unfence(expr: str) -> str:
    """Stripped text without a leading ```json / ``` and a trailing ``` fence."""
    return f"regexp_replace(regexp_replace({py_strip(expr)}, '^```(?:json)?\\s*', ''), '\\s*```$', '')"


def py_first_word(expr: str) -> str:
    """``expr.split()[0] if " " in expr else ""`` (Python whitespace rules)."""
    from dealerlens.operators.text import PY_WS_CLASS

    return (f"CASE WHEN strpos({expr}, ' ') > 0 "
            f"THEN string_split_regex({py_strip(expr)}, '{PY_WS_CLASS}+')[1] ELSE '' END")
