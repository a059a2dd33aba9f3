"""Text normalizers as Column expressions. They differ on purpose; each names what it keeps and drops."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters whose compatibility decomposition is one plain letter and marks, and that letter."""
    pairs = []
    for code in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(bare) == 1 and bare != c and bare.isascii() and bare.isalpha():
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Latin letters with a mark and their plain form, position by position (lower case).
ACCENTED, PLAIN = _plain_letters()
SPACES = r"(?U)\s+"


def unaccent(c: Column | str) -> Column:
    """Lower case without Latin diacritics, composed or combining; ß stays."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def squeeze(c: Column | str) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def evidence_key(c: Column | str) -> Column:
    """Key under which two pieces of evidence repeat each other: lower case, single blanks, no closing ``.,;:`` (F1)."""
    return F.rtrim(squeeze(F.lower(c)), F.lit(".,;:"))


def layout_text(c: Column | str) -> Column:
    """Text with single blanks in lines, none at line starts and at most one empty line in a row; blank gives null (F2 without absence)."""
    col = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(col, r"^(?U)\s+|(?U)\s+$", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.nullif(t, F.lit(""))


# Texts that say that there is nothing, and endings that do.
ABSENT = ("nao ha", "nao possui", "nao se aplica", "sem bibliografia", "sem informacao", "nao informado", "nao informada", "-")
ABSENT_ENDINGS = (": nao ha", ": nao se aplica", ": nao possui", ": sem bibliografia")


def comparison_key(c: Column | str) -> Column:
    """Lower case, no diacritics, single blanks."""
    return squeeze(unaccent(c))


def says_absent(c: Column | str) -> Column:
    """Whether a text says that there is no content."""
    key = F.trim(F.rtrim(comparison_key(c), F.lit(".:;")))
    ends = F.lit(False)
    for e in ABSENT_ENDINGS:
        ends = ends | key.endswith(e)
    return key.isin(*ABSENT) | ends


def content_text(c: Column | str) -> Column:
    """:func:`layout_text`, with null for texts that say that there is nothing (F2 + F4)."""
    t = layout_text(c)
    return F.when(~says_absent(t), t)


def table_key(c: Column | str) -> Column:
    """Only plain letters and digits."""
    return F.regexp_replace(unaccent(c), "[^a-z0-9]", "")


def merge_key(c: Column | str) -> Column:
    """Letters and digits, anything else as one blank."""
    return F.trim(F.regexp_replace(unaccent(c), "[^a-z0-9]+", " "))


def identity_key(c: Column | str) -> Column:
    """Lower case and single blanks, accents kept."""
    return squeeze(F.lower(c))


def code_key(c: Column | str) -> Column:
    """Codes compare in upper case without outer blanks."""
    return F.upper(F.trim(c))


def without_course_code(c: Column | str) -> Column:
    """A course name without the code before it, such as ``ABC123 -``."""
    return F.regexp_replace(c, r"^\s*[A-Za-z]{1,10}\s*\d+\s*[-–—:]\s*", "")


def optional_text(c: Column | str) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(F.trim(c), F.lit(""))


def single_line(c: Column | str) -> Column:
    """One line; null as empty."""
    return squeeze(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def base_name(c: Column | str) -> Column:
    """File name of a Unix or Windows path."""
    return F.regexp_extract(c, r"[^/\\]+$", 0)


def course_name(c: Column | str) -> Column:
    """A course name up to a label that follows it on the line, without outer marks."""
    t = F.get(F.split(c, r"(?iu)\b(?:carga\s+hor[aá]ria|per[ií]odo\s+letivo|docente|professor|turmas?)\s*:"), 0)
    return F.trim(F.regexp_replace(t, r"(?i)\s+turmas?\s*$", ""), F.lit(" |:–-"))


def without_bullets(c: Column | str) -> Column:
    """Text without bullet marks at line starts, blank as null."""
    return F.nullif(F.trim(F.regexp_replace(c, "(?m)^[ \\t]*[\u2022\u2023\u25e6\u2043\u2219\uf0b7\uf0a7]+[ \\t]*", "")), F.lit(""))


def quantity(c: Column | str) -> Column:
    """A number with a decimal comma or point and perhaps ``h`` or ``hora(s)``; anything else is null."""
    t = F.replace(single_line(c), F.lit(","), F.lit("."))
    return F.regexp_extract(t, r"^(?i)(\d+(?:\.\d+)?)\s*(?:h|horas?)?$", 1).try_cast("double")


def sentence_pieces(c: Column | str) -> Column:
    """Pieces after closing marks and white space, trimmed, blank ones left out (F16, ementa)."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])(?U)\s+"), _strip), lambda x: x != "")


def list_pieces(c: Column | str) -> Column:
    """Pieces between line ends and semicolons, trimmed, blank ones left out (F16, lists)."""
    return F.filter(F.transform(F.split(c, r"\n+|;"), _strip), lambda x: x != "")


def content_lines(c: Column | str) -> Column:
    """Lines, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), _strip), lambda x: x != "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


# Section labels by field, on lower-case text without accents; labels of ``_parar`` end a section.
SECTIONS = {
    "ementa": ("ementa", "ementario", "ementa da disciplina", "ementa da disciplina no curso"),
    "objetivos.geral": ("objetivo geral", "objetivos gerais", "objetivo geral / *topico gerador"),
    "objetivos.especificos": ("objetivos especificos", "objetivo especifico", "objetivos especificos / *metas de compreensao"),
    "objetivos.nao_classificados": ("objetivos", "objetivos da disciplina", "objetivos de aprendizagem", "objetivo", "objetivos da disciplina no curso"),
    "competencias_habilidades": ("competencias e habilidades", "competencias/habilidades", "habilidades e competencias", "competencias", "competencias especificas", "habilidades", "habilidades a serem desenvolvidas"),
    "conteudo_programatico": ("conteudo programatico", "conteudos programaticos", "programa", "unidades de ensino", "estrutura da disciplina", "conteudo de ensino"),
    "bibliografia.basica": ("bibliografia basica", "referencias basicas", "referencia basica", "bibliografia obrigatoria"),
    "bibliografia.complementar": ("bibliografia complementar", "referencias complementares", "referencia complementar"),
    "bibliografia.nao_classificada": ("bibliografia", "bibliografias", "referencias", "referencias bibliograficas"),
    "_parar": (
        "metodologia", "metodologia de ensino", "metodologia de ensino e aprendizagem", "procedimentos metodologicos", "avaliacao", "avaliacao da aprendizagem", "criterios de avaliacao", "sistema de avaliacao",
        "perfil do egresso", "cronograma", "cronograma de aulas", "cronograma de atividades", "estrategias de ensinagem", "recursos didaticos", "objetivos do curso", "objetivo geral do curso",
        "objetivos especificos do curso", "justificativa", "contextualizacao", "procedimentos metodologico", "procedimento metodologico", "pesquisar novamente",
    ),
}


def section_header(c: Column) -> Column:
    """The section that a line opens and the text after its label, as struct<campo, valor>; null if it is no header.

    A line counts with or without numbering, with a value after a colon, and with every letter doubled as
    overprinted titles come out. Labels are looked up in one map, so all lines cost the same.
    """
    labels = F.create_map(*(F.lit(x) for field, names in SECTIONS.items() for name in names for x in (name, field)))
    line = F.regexp_replace(F.regexp_replace(c, r"^\s*(?:\d+(?:\.\d+)*(?:\s*[.\-–):]\s*|\s+))", ""), r"^\s+|\s+$", "")
    # each step is bound once, as the element of an array of one: written out, the keys would stand there many times
    keys = F.transform(F.array(line), lambda x: F.struct(x.alias("l"), F.trim(comparison_key(x), F.lit(" :;().")).alias("k"), F.trim(comparison_key(F.substring_index(x, ":", 1)), F.lit(" ()")).alias("b")))

    def opened(x: Column) -> Column:
        halved = F.regexp_replace(x["k"], r"(.)\1", "$1")
        doubled = (F.length(x["k"]) % 2 == 0) & (F.length(halved) * 2 == F.length(x["k"]))
        whole = F.coalesce(F.when(doubled, labels[halved]), labels[x["k"]])
        after = F.when(F.contains(x["l"], F.lit(":")) & whole.isNull(), _strip(F.regexp_replace(x["l"], r"^[^:]*:", ""))).otherwise("")
        field = F.coalesce(whole, F.when(F.contains(x["l"], F.lit(":")), labels[x["b"]]))
        return F.when(field.isNotNull(), F.struct(field.alias("campo"), after.alias("valor")))

    return F.get(F.transform(keys, opened), 0)


def is_course_name(c: Column) -> Column:
    """Whether a line may be a course's name: of fair length, with letters, no header, no label and no row of figures."""
    key = comparison_key(c)
    label = key.rlike(r"^(?:carga horaria|periodo|codigo|professor|docente|nota|nome:|turma|ementa de|plano de|curso\b)")
    bare = key.isin("teorica", "pratica", "hibrida", "teorico pratica", "nome", "nota carga horaria")
    figures = key.rlike(r"(?:\s+\d+(?:[,.]\d+)?){3,}\s*$") | key.rlike(r"^[\d\W]+$")
    return F.length(c).between(3, 180) & key.rlike("[a-z]{3}") & section_header(c).isNull() & ~label & ~bare & ~figures
