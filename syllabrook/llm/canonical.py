"""Problem 6: freely typed values mapped to a reference list, in SQL only.

Method: partition-based pigeonhole join. A reference form of length L that may be k edits away is cut
into k + 1 segments; a value within k edits holds at least one segment unchanged, at a place that
differs by few positions. Values and segments meet in an equality join on (length, segment number,
substring), Spark's ``levenshtein`` verifies, and an anti-join reports the values without an entry.
Both sides are tables of distinct forms; no side is assumed to be small and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from syllabrook.llm.name_forms import INSTITUTION_HEADS, bare_form_sql, form_sql, part_steps, plain_steps
from syllabrook.session import cut_lineage

#: Edits allowed by the length of a reference form. Forms of up to 5 letters are initialisms, which lie within one
#: slip of each other (of 130 reference initialisms most have another at one edit), so they must be met exactly.
EDITS = "CASE WHEN length(form) <= 5 THEN 0 WHEN length(form) <= 11 THEN 2 WHEN length(form) <= 19 THEN 3 ELSE 4 END"

_READINGS = """
SELECT DISTINCT nome, form, length(form) AS n FROM (
  SELECT nome, explode(array({value_form}, {bare_form})) AS form FROM ({parts})
) WHERE form <> ''
"""

_MATCH = """
WITH forms AS (
  SELECT *, {edits} AS k, length(form) AS len FROM {{references}} WHERE form <> ''
),
readings AS (
  SELECT * FROM {{readings}}
),
names AS (
  SELECT DISTINCT nome FROM {{names}} WHERE nome IS NOT NULL
),
exact AS (
  SELECT r.nome, f.referencia_id, 0 AS distance, f.weight FROM readings r JOIN forms f ON r.form = f.form
),
segments AS (
  SELECT referencia_id, weight, form, len, k, i,
         i * len DIV (k + 1) AS start,
         substring(form, i * len DIV (k + 1) + 1, (i + 1) * len DIV (k + 1) - i * len DIV (k + 1)) AS piece
  FROM forms LATERAL VIEW explode(sequence(0, k)) AS i WHERE k > 0
),
shapes AS (
  SELECT DISTINCT len, k, i, start, length(piece) AS size FROM segments
),
wanted AS (
  SELECT nome, form, n, explode(sequence(greatest(n - 4, 1), n + 4)) AS len
  FROM readings r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.nome = r.nome)
),
places AS (
  -- with i errors at most before the segment and k - i after it, it starts within these positions
  SELECT w.nome, w.form, w.n, s.len, s.k, s.i, s.size,
         explode(sequence(
           greatest(0, s.start - s.i, s.start + (w.n - s.len) - (s.k - s.i)),
           greatest(greatest(0, s.start - s.i, s.start + (w.n - s.len) - (s.k - s.i)), least(w.n - s.size, s.start + s.i, s.start + (w.n - s.len) + (s.k - s.i)))
         )) AS at
  FROM wanted w JOIN shapes s ON w.len = s.len WHERE abs(w.n - s.len) <= s.k AND w.n >= s.size
),
candidates AS (
  SELECT DISTINCT p.nome, p.form, s.referencia_id, s.weight, s.form AS reference_form, s.k
  FROM places p JOIN segments s ON p.len = s.len AND p.i = s.i AND substring(p.form, p.at + 1, p.size) = s.piece
),
near AS (
  SELECT nome, referencia_id, weight, levenshtein(form, reference_form, k) AS distance, k,
         -- exchanged letters count two edits but are one slip
         CASE WHEN array_sort(split(form, '')) = array_sort(split(reference_form, '')) THEN 1 ELSE 0 END AS exchanged,
         CASE WHEN left(form, 1) = left(reference_form, 1) THEN 0 ELSE 1 END AS other_initial
  FROM candidates
),
scored AS (
  SELECT nome, referencia_id, struct(CAST(0 AS DOUBLE) AS cost, weight, referencia_id AS id) AS rank FROM exact
  UNION ALL
  SELECT nome, referencia_id, struct(distance - 1.0 * exchanged + 0.25 * other_initial AS cost, weight, referencia_id AS id) AS rank FROM near WHERE distance BETWEEN 0 AND k
),
best AS (
  SELECT nome, min_by(referencia_id, rank) AS referencia_id FROM scored GROUP BY nome
)
"""

_ALL = """
SELECT v.id, coalesce(b.referencia_id, CAST(-1 AS BIGINT)) AS referencia_id
FROM {{values}} v LEFT JOIN (
  SELECT nome, referencia_id FROM best
  UNION ALL
  SELECT nome, CAST(-1 AS BIGINT) FROM names n WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.nome = n.nome)
) b ON v.nome = b.nome
"""


def map_values(values: DataFrame, id_col: str, name_col: str, references: DataFrame, short: Sequence[tuple[str, str]]) -> DataFrame:
    """Each value with its reference entry: (id, referencia_id), -1 where the list has none.

    ``references`` has (referencia_id, form, weight): forms as :func:`reference_forms` makes them.
    Null, empty and meaningless values get -1. Repeated values get the same entry, equal ids stay
    apart. Of entries equally near, the one with the lower weight, then the smaller id is taken. An
    empty reference list maps all to -1; an empty table gives an empty result.
    """
    spark = values.sparkSession
    own = values.selectExpr(f"`{id_col}` AS id", f"`{name_col}` AS nome")
    names = "(SELECT DISTINCT nome FROM {names} WHERE nome IS NOT NULL)"
    read = _READINGS.format(parts=part_steps(plain_steps(names, "nome", "nome"), "nome"), value_form=form_sql("part", short), bare_form=bare_form_sql("part"))
    # both are read by several branches; written once, they also keep the plan of the match short
    readings, references = cut_lineage(spark.sql(read, names=own)), cut_lineage(references)
    return spark.sql(_MATCH.format(edits=EDITS) + _ALL.format(), names=own, readings=readings, values=own, references=references)


def _forms(entries: DataFrame, full: str, others: str, columns: str = "") -> DataFrame:
    """(referencia_id, form, weight) of a reference list: its ``full`` form at weight 0 and ``others``, from one scan."""
    plain = plain_steps("{entries}", "nome", "referencia_id", *columns.split())
    sql = f"""
    SELECT referencia_id, form.form AS form, min(form.weight) AS weight FROM (
      SELECT referencia_id, explode(array(struct(full AS form, 0 AS weight), {others})) AS form FROM (
        SELECT {full} AS full, * FROM ({plain})
      )
    ) WHERE form.form IS NOT NULL GROUP BY referencia_id, form.form
    """
    return entries.sparkSession.sql(sql, entries=entries)


def institution_forms(entries: DataFrame, short: Sequence[tuple[str, str]]) -> DataFrame:
    """Forms under which an institution is looked up: its name, its initials, its name with the leading nouns shortened or without the first."""
    heads = ", ".join(f"struct(CASE WHEN full LIKE '{long}%' THEN regexp_replace(full, '^{long}', '{head}') END AS form, 3 AS weight)" for long, some in INSTITUTION_HEADS for head in some)
    sigla = "struct(regexp_replace(translate(lower(sigla), 'áàâãäéèêëíìîïóòôõöúùûüç', 'aaaaaeeeeiiiiooooouuuuc'), '[^a-z0-9]', '') AS form, 1 AS weight)"
    return _forms(entries, form_sql("plain", short), f"{heads}, {sigla}, struct(regexp_replace(full, '^universidade(?=federal|estadual)', '') AS form, 2 AS weight)", "sigla")


def course_forms(entries: DataFrame, short: Sequence[tuple[str, str]]) -> DataFrame:
    """Forms under which a course of study is looked up: its name, and what follows ``Ciências``."""
    return _forms(entries, form_sql("plain", short), "struct(regexp_replace(full, '^ciencias', '') AS form, 2 AS weight)")
