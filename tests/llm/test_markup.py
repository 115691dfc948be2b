from __future__ import annotations

import pytest

from quillgraph.llm import markup as M
from quillgraph.operators.current import current_rows

MARKED = {
    "Una <b>zona</b> lenta": "Una zona lenta",
    "fin.<br>Otra": "fin.\nOtra",
    "uma</a> etiqueta": "uma etiqueta",
    "a &amp;nbsp; b": "a b",
    "a&#160; b &lt; c": "a b < c",
    "dos <!-- nota --> tres": "dos tres",
    '<img src="x.png" alt="foto"> lenta': "foto lenta",
    "**Cada** zona": "Cada zona",
    "***una*** zona": "una zona",
    "una _merma_ oculta": "una merma oculta",
    "__una__ ficha": "una ficha",
    "un ~~palé~~ dos": "un palé dos",
    "un ==**registro**== dos": "un registro dos",
    "un `palé` dos": "un palé dos",
    "el [pero](../rule/x-4.md) no": "el pero no",
    'el [p](a.md "p") no': "el p no",
    "el [p][1] no": "el p no",
    "![Um](img/x.png) painel": "Um painel",
    "cada[^7] embalaje": "cada embalaje",
    "un \\*sealed\\* x": "un *sealed* x",
    "> cita de uno": "cita de uno",
    "una ''voz'' baja": "una voz baja",
    "una '''''voz''''' baja": "una voz baja",
    "la [[sla/route-603|La]] no": "la La no",
    "un [[detrás]] no": "un detrás no",
    "un [[Archivo:el.png|thumb|el [[el]]]] no": "un el el no",
    "un {{nota|{{aviso|estante}}|pie=exception/x-8}} no": "un estante no",
    "__NOTOC__pesar": "pesar",
    "un <nowiki>la</nowiki> no": "un la no",
    "uno<ref>a/b-1</ref> dos": "uno dos",
    "un \\texttt{um} dos": "un um dos",
    "La \\textbf{\\emph{ruta}} no": "La ruta no",
    "un \\href{a/b}{c} no": "un c no",
    "uno\\footnote{a-1} dos": "uno dos",
    "un {\\it Además} no": "un Además no",
    "caf\\'{e} con": "café con",
    "un ``dos'' tres": "un dos tres",
    "una $d_{0}$ previa": "una d_{0} previa",
    "una \\(s^2\\) previa": "una s^2 previa",
    "mientras~\\% una": "mientras % una",
}
PLAIN = [
    "El total es 34 * 11 * 3 unidades.",
    "2*3*4 y 5 * 6",
    "Tasa: 71% / 37% (aprox.).",
    "Costó US$ 17 y no US$ 4.",
    "x == 6 | y == 5",
    "Si peso < 21 y alto > 10, pasa directo.",
    "Margen de ~26 kg -- nunca más de 22.",
    "Usar lista[33] {peso, alto} como entrada.",
    "El equipo de I&D pidió 7 lecturas.",
    "La clave peso_neto_kg vale 38 y la clave alto_max vale 19.",
    "Se guarda en D:\\bultos\\77 sin copia.",
    "El lote #76 sigue al lote #10.",
    "Rack 'A' = rack \"B\" + 7.",
    "Any order can't outlive dock 41's logbook; the dogs' and cats' rules.",
    "the route nututubuq_id. 🚚🏽La merma.→Fin",
    "",
    "   ",
]


@pytest.mark.parametrize("text", list(MARKED))
def test_marked(text):
    out = M.clean(text)
    assert out["marks"] > 0
    assert out["text"] == MARKED[text]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_has_no_markup(text):
    out = M.clean(text)
    assert out["marks"] == 0
    assert out["text"].strip() == text.strip()


def test_plain_shortcut_is_no_narrower_than_the_rules():
    for text, want in {"uno}} dos": "uno dos", "uno]] dos": "uno dos", "uno\r- dos": "uno\n\n• dos", "uno\r1. dos": "uno\n\n1. dos"}.items():
        out = M.clean(text)
        assert (out["text"], out["marks"]) == (want, 1)
    assert M.clean("uno} dos] tres\rcuatro")["marks"] == 0


def kinds(text):
    return [(b["kind"], b["text"]) for b in M.clean(text)["blocks"]]


def test_structure_is_kept():
    md = "## Uno\n\ntexto\n\n- a\n- b\n\n```py\nx = 1  # **no**\n\n```\n\n| item | kg |\n|---|---:|\n| a | 1 |\n\n$$w_1 = \\frac{1}{2}$$"
    want = [("heading", "Uno"), ("text", "texto"), ("list", "a\nb"), ("code", "x = 1  # **no**"), ("table", "item\tkg\na\t1"), ("formula", "w_1 = \\frac{1}{2}")]
    assert kinds(md) == want
    html = "<h2>Uno</h2><p>texto</p><ul><li>a</li><li>b</ul><pre><code>x &lt; 1</code></pre><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
    assert kinds(html) == [("heading", "Uno"), ("text", "texto"), ("list", "a\nb"), ("code", "x < 1"), ("table", "a\t1\nb\t2")]
    wiki = "== Uno ==\ntexto\n* a\n** b\n\n{| class=\"x\"\n|-\n| a || 1\n|}\n<syntaxhighlight lang=\"text\">\ny\n</syntaxhighlight>\n<math>k</math>"
    assert kinds(wiki) == [("heading", "Uno"), ("text", "texto"), ("list", "a\nb"), ("table", "a\t1"), ("code", "y"), ("formula", "k")]
    tex = "\\subsection{Uno}\n\ntexto\n\n\\begin{itemize}\n  \\item a\n  \\item b\n\\end{itemize}\n\\begin{tabular}{lr}\na & 1 \\\\\nb & 2 \\\\\n\\end{tabular}\n\\begin{verbatim}\nz = 1\n\\end{verbatim}\n\\[q\\]"
    assert kinds(tex) == [("heading", "Uno"), ("text", "texto"), ("list", "a\nb"), ("table", "a\t1\nb\t2"), ("code", "z = 1"), ("formula", "q")]
    assert kinds("Contenedor\n==========\r\n\r\nuno")[0] == ("heading", "Contenedor")


def test_no_text_is_lost_with_notes_and_comments():
    out = M.clean("uno<ref name=x>a **b** `c*`</ref> dos\\footnote{see \\emph{d} and \\'{e}} tres <ref></ref>")
    assert out["text"] == "uno dos tres" and out["notes"] == ["a b c*", "see d and é"]
    assert M.clean("uno\\footnote{a-1} dos")["notes"] == ["a-1"]
    assert M.clean("uno <!-- x --> dos <!-- tres\ncuatro")["text"] == "uno dos tres\ncuatro"
    assert M.clean("x")["notes"] == M.clean(None)["notes"] == []
    M.clean("<!-- " * 20_000)


def test_levels_and_numbers_are_kept():
    text = "# Uno\n\n### **Dos**\n\n1. a\n2. *b*\n- **c**\n\n<h4>Tres</h4>\n== Cuatro ==\n\\subsection{Cinco}\nSeis\n----"
    out = M.clean(text)
    heads = [(b["level"], b["text"]) for b in out["blocks"] if b["kind"] == "heading"]
    assert heads == [(1, "Uno"), (3, "Dos"), (4, "Tres"), (2, "Cuatro"), (3, "Cinco"), (2, "Seis")]
    assert "1. a\n2. b\n• c" in out["text"]


NAVIGATION = "[Inicio](/) | [Guía](/g)\n<a href='/x'>Contacto</a>\n[[Portada]]\n\n"


def test_runs_of_links_are_navigation():
    """What lies outside of surge and dive goes; switching the step off keeps it."""
    page = NAVIGATION + "El palé **no** cabe.\n\nVer [la regla](r.md).\n\n" + "[uno](a)\n\n[dos](b)\n"
    assert M.clean(page)["text"] == "El palé no cabe.\n\nVer la regla."
    assert M.clean(page, surge=0)["text"] == "Inicio | Guía\nContacto\nPortada\n\nEl palé no cabe.\n\nVer la regla.\n\nuno\n\ndos"
    assert M.clean(page)["residue"]


def test_links_that_are_no_navigation_stay():
    assert M.clean(NAVIGATION)["text"] == "Inicio | Guía\nContacto\nPortada"  # nothing else is there
    assert M.clean("uno\n[dos](b)\ntres")["text"] == "uno\ndos\ntres"  # between lines of text
    assert M.clean("uno\n\n\n\n\n- [dos](b)\n")["text"] == "uno\n\n• dos"  # a list
    assert M.clean("uno\n\n\n\n\ndos\n\n\n\n\n\n**\n\n3")["text"] == "uno\n\ndos\n\n**\n\n3"  # plain lines, however short


def test_kept_lines():
    assert M.kept_lines([0, 0, 5, 0, 5, 0, 0, 0, 0, 5, 0], 3, 1) == [False, False, True, True, True, False, False, False, False, True, False]
    assert M.kept_lines([0, 0], 3, 1) == [True, True] and M.kept_lines([], 3, 1) == []


def test_line_blocks():
    assert M.line_blocks([5, 0, 0, 0, 0, 5], 3, 1) == [True, True, True, True, True, True]
    assert M.line_blocks([5, 0, 0, 0, 0, 0, 5], 2, 1) == [True, True, False, False, False, True, True]
    assert M.line_blocks([1, 1, 50, 40, 1, 1, 1], 2, 40) == [False, True, True, True, True, False, False]
    assert M.line_blocks([], 3, 1) == []


def test_long_texts_are_quick():
    for unit in ("z", "_a", "* ", "[", "<", "`a", "{{", "=", "'", "\\x{", "\n", "$ "):
        M.clean(unit * 20_000)


def test_column(spark):
    schema = "id string, body string, updated_at timestamp_ntz, text string, marks int"
    entities = spark.createDataFrame([("a", "**x**", None, "t", 1), ("b", None, None, "t", 1), ("c", "", None, "t", 1), (None, "**", None, "", 0)], schema)
    components = spark.createDataFrame([("a", "x"), ("a", "x"), ("k", "<b>x</b>")], "id string, body string")
    out = M.clean_bodies(entities, components, current_rows)
    got = {(r["src_table"], r["id"], r["text"], r["marks"] > 0) for r in out.collect()}
    want = {("entities", "a", "x", True), ("entities", "b", None, False), ("entities", "c", "", False), ("components", "a", "x", False), ("components", "k", "x", True)}
    assert got == want and out.count() == 5
    assert M.clean_bodies(entities.limit(0), components.limit(0), current_rows).count() == 0
