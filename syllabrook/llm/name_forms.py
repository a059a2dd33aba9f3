"""Fixed values and SQL expressions that bring typed names of institutions and courses to comparable forms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from syllabrook.functions.text import ACCENTED, PLAIN

# UTF-8 text read as Latin-1 or Windows-1252 has a letter as "Ã" and the character of its second byte; that
# byte stands for the letter 0x40 above. Both strings follow from this rule.
def _second_bytes() -> tuple[str, str]:
    seen: dict[str, str] = {}
    for byte in range(0x80, 0xC0):
        letter = chr(byte + 0x40).lower()
        if letter not in ACCENTED:
            continue
        for charset in ("latin-1", "cp1252"):
            shown = bytes([byte]).decode(charset, "ignore").lower()
            if shown:
                seen.setdefault(shown, PLAIN[ACCENTED.index(letter)])
    return "".join(seen), "".join(seen.values())


SECOND, SECOND_PLAIN = _second_bytes()
# Abbreviations people use, as regular expressions on lower-case text without accents.
INSTITUTION_SHORT = (
    (r"\b(fac|facu|facul|facs|fculd)\b\.? ?(integr?|integrad|int)\b", "faculdades integradas"), (r"\bfatec\b|\bfactec\b|\bfac ?tec\b|\bft\b", "faculdade tecnologia"),
    (r"\bunicentro\b|\bcu\b|\bc univ\w*", "centro universitario"), (r"\b(ctro|cent|centr) (universit\w*|univ\w*)", "centro universitario"), (r"\bcentro (univ|univers|universit)\b", "centro universitario"),
    (r"\buf\b|\bunifed\b", "universidade federal"), (r"\bue\b|\buniest\b", "universidade estadual"), (r"\bif\b", "instituto federal"),
    (r"\bu\b|\b(univ|univers|universid|universidad)\b", "universidade"), (r"\b(fed|feder)\b", "federal"), (r"\b(est|estad)\b", "estadual"), (r"\b(inst|instit|institut)\b", "instituto"),
    (r"\b(fac|facu|facul|faculd)\b", "faculdade"), (r"\bfacs\b", "faculdades"), (r"\b(tec|tecn|tecno|tecnol|tecno l)\b", "tecnologia"), (r"\b(ctro|cent|centr)\b", "centro"), (r"\b(universit|universitar)\b", "universitario"),
    (r"\besc\b", "escola"), (r"\bsup\b", "superior"), (r"\b(integr|integrad|int)\b", "integradas"), (r"\bmte\b", "monte"), (r"\bs\b(?=[ ,]|$)", "sao"), (r"\bsta\b", "santa"), (r"\bpto\b", "porto"), (r"\bvl\b", "vila"), (r"\blag\b", "lagoa"), (r"\bcach\b", "cachoeira"),
)
COURSE_SHORT = (
    (r"\bcurso superior (de|em)\b|\bcurso (de|em)\b|\bgraduacao em\b|\bgrad em\b|\bgrad\b|\bbacharelado em\b|\bbacharelado\b|\bbach em\b|\bbach\b|\blicenciatura em\b|\blicenciatura\b|\blic em\b|\blic\b|\btecnologo em\b|\bcst em\b|\bcst\b", " "),
    (r"\bnoturno\b|\bmatutino\b|\bvespertino\b|\bintegral\b|\bead\b|\bpresencial\b|\bcurriculo (novo|antigo)\b|\b(19|20)\d\d\b", " "),
    (r"\brh\b", "recursos humanos"), (r"\bads\b", "analise desenvolvimento sistemas"), (r"\bti\b", "tecnologia informacao"), (r"\b(enga|engo|eng|engen|engenh)\b", "engenharia"), (r"\b(gest|gst)\b", "gestao"), (r"\b(tecnol|tec|tecn)\b", "tecnologia"),
    (r"\brel\b", "relacoes"), (r"\b(internac|intern)\b", "internacionais"), (r"\b(cienc|cien|ci|c)\b", "ciencias"), (r"\b(adm|admin|administr)\b", "administracao"), (r"\b(arq|arquit)\b", "arquitetura"), (r"\burb\b", "urbanismo"),
    (r"\b(comp|comput)\b", "computacao"), (r"\bprod\b", "producao"), (r"\b(ed|educ)\b", "educacao"), (r"\bfis\b", "fisica"), (r"\b(sist|sistem)\b", "sistemas"), (r"\b(inf|inform)\b", "informacao"), (r"\b(desenv|desenvolv)\b", "desenvolvimento"), (r"\b(vet|veter|veterin)\b", "veterinaria"), (r"\bmed\b", "medicina"),
    (r"\b(amb|ambient)\b", "ambiental"), (r"\b(ind|industr)\b", "industrial"), (r"\b(contab|cont)\b", "contabeis"), (r"\b(econ|econom)\b", "economicas"), (r"\b(biol|biolog)\b", "biologicas"), (r"\bsoc\b", "social"), (r"\b(mat|matem)\b", "matematica"), (r"\b(aplic|apl)\b", "aplicada"), (r"\b(port|portug)\b", "portugues"), (r"\b(esp|espan)\b", "espanhol"),
    (r"\bpub\b|\bpubl\b", "publicidade"), (r"\bprop\b|\bpropag\b", "propaganda"), (r"\bseg\b", "seguranca"), (r"\btrab\b", "trabalho"), (r"\b(proc|process)\b", "processos"), (r"\bger\b|\bgerenc\b", "gerenciais"), (r"\b(secret|secr)\b", "secretariado"), (r"\b(exec|execut)\b", "executivo"), (r"\b(terap|ter)\b", "terapia"), (r"\b(ocup|ocupac)\b", "ocupacional"), (r"\b(eletr|eletric)\b", "eletrica"), (r"\b(mec|mecan)\b", "mecanica"), (r"\bciv\b", "civil"), (r"\b(quim|qui)\b", "quimica"),
    (r"\balim\b|\balimen\b", "alimentos"), (r"\bhosp\b|\bhospital\b", "hospitalar"), (r"\bcom\b|\bcomerc\b", "comercial"), (r"\b(telecom|telecomunic)\b", "telecomunicacoes"), (r"\bdes\b", "design"), (r"\bgraf\b", "grafico"), (r"\b(florest|flor)\b", "florestal"),
)
# How the leading nouns of institutions are shortened, letters run together.
INSTITUTION_HEADS = (
    ("universidadefederal", ("univfed", "universfed", "ufed", "uniffed")), ("universidadeestadual", ("univest", "universest", "univestad", "universestad", "uest", "uestad")), ("institutofederal", ("instfed", "institfed")),
    ("centrouniversitario", ("ctrouniv", "ctrouniversit", "cuniv", "cuniversit", "ctrounivers", "centuniv")), ("faculdadetecnologia", ("factec", "facultec", "factecnol", "facultecnol")),
)
STOP = r"\b(de|do|da|dos|das|e|em|no|na|a|o|the)\b"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plain_steps(source: str, column: str, *others: str) -> str:
    """A query over ``source`` that adds ``plain``: lower case, mojibake undone, no diacritics, dotted initials closed up, any white space as one blank.

    Each step is a subquery with a column of its own, so that no expression is written twice and plans stay short.
    """
    keep = "".join(f"{c}, " for c in others)
    low = f"SELECT {keep}translate(replace(lower({column}), 'â€“', ' - '), '–—', '--') AS low FROM {source}"
    broken = f"ã(?=[{SECOND}])"
    whole = f"SELECT {keep}CASE WHEN low RLIKE {_quote(broken)} THEN translate(regexp_replace(low, {_quote(broken)}, ''), {_quote(SECOND)}, {_quote(SECOND_PLAIN)}) ELSE low END AS low FROM ({low})"
    x = f"translate(low, {_quote(ACCENTED + 'ªº')}, {_quote(PLAIN + 'ao')})"
    x = f"regexp_replace({x}, {_quote(r'(?U)\\s+')}, ' ')".replace("\\\\\\\\", "\\\\")
    x = f"regexp_replace({x}, {_quote(chr(92) + 'b([a-z])[.](?=[a-z])')}, '$1')"
    return f"SELECT {keep}trim(regexp_replace({x}, {_quote('[.]([a-z])' + chr(92) + 'b(?![.])')}, '$1')) AS plain FROM ({whole})"


def part_steps(source: str, *others: str) -> str:
    """A query over ``source`` (with ``plain``) that gives one row for each way to read a plain name, as ``part``.

    The ways: without bracketed notes, each part between dashes and slashes, parts around a comma swapped.
    """
    keep = "".join(f"{c}, " for c in others)
    noted = f"SELECT {keep}regexp_replace(regexp_replace(plain, {_quote(chr(92) + '([^)]*' + chr(92) + ')')}, ' '), {_quote(chr(92) + 'bs/c' + chr(92) + 'b')}, ' ') AS noted FROM ({source})"
    split = f"SELECT {keep}noted, split(noted, {_quote(' - |[/|;]')}) AS pieces FROM ({noted})"
    swapped = "transform(pieces, p -> CASE WHEN p LIKE '%,%' THEN concat(substring_index(p, ',', -1), ' ', substring_index(p, ',', 1)) ELSE p END)"
    return f"SELECT {keep}explode(array_distinct(concat(array(noted), pieces, {swapped}))) AS part FROM ({split})"


def bare_form_sql(part: str) -> str:
    """A part as typed, without small words, as letters and digits run together."""
    return form_sql(part, ())


def expand_sql(words: str, short: Sequence[tuple[str, str]]) -> str:
    """Words (letters and digits between single blanks) with abbreviations spelled out: whole words by a table, others by pattern."""
    table: dict[str, str] = {}
    for pattern, full in short:
        if re.fullmatch(r"(\|?\\b(\([a-z|]+\)|[a-z]+)\\b)+", pattern):
            for word in re.findall(r"[a-z]+", pattern.replace(r"\b", " ")):
                table.setdefault(word, full)
        else:
            words = f"regexp_replace({words}, {_quote(pattern)}, {_quote(full)})"
    if table:
        entries = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
        words = f"array_join(transform(split({words}, ' +'), t -> coalesce(map({entries})[t], t)), ' ')"
    return words


def form_sql(part: str, short: Sequence[tuple[str, str]]) -> str:
    """A part with abbreviations spelled out, without small words, as letters and digits run together."""
    words = expand_sql(f"trim(regexp_replace({part}, '[^a-z0-9]+', ' '))", short)
    return f"regexp_replace(regexp_replace({words}, {_quote(STOP)}, ''), ' +', '')"
