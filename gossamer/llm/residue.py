"""Template residue, filler and error-page text.

One grammar per delimiter finds placeholders that a template left unfilled. A hit doesn't count inside code elements, in quotes, or
in a sentence that speaks of templates on a page that shows code: such pages are about placeholders. Filler is found by default
phrases that make up a whole sentence and by the density of pseudo-Latin words; error messages and script notices count where the own
content is short enough that they stand instead of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.html import is_html, page_text, title_of
from gossamer.llm.boilerplate import fitted_model, label_page
from gossamer.llm.content_model import ContentModel
from gossamer.llm.page import CODE_TAGS, Page
from gossamer.session import spread

#: One grammar per delimiter, as alternatives. A body excludes its own delimiters and newlines; its length plays no part.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}"  # {{ name }}
    r"|\$\{[^{}\n]+\}"  # ${name}
    r"|<%[^%\n]+%>"  # <%= name %>
    r"|\{%[^%\n]+%\}"  # {% block %}
    r"|\[\[[^\[\]\n]+\]\]"  # [[NAME]]
    r"|%%\w[\w .-]*%%"  # %%NAME%%
    r"|@@[\w.-]+@@"  # @@name@@
    r"|##[A-Z][A-Z0-9_]+##|(?<![\w#])#[A-Z][A-Z0-9_]{2,}#(?!\w)"  # ##NAME##, #NAME#
    r"|\$[A-Z][A-Z0-9_]+\$"  # $NAME$
    r"|(?<!\w)__[A-Z][A-Z0-9_]+__(?!\w)"  # __NAME__
    r"|(?<!\w)XX_[A-Z0-9_]+_XX(?!\w)|(?<!\w)[A-Z]+_(?:GOES|COMES)_HERE(?!\w)|(?<!\w)(?:YOUR|INSERT|ENTER|REPLACE)_[A-Z_]{2,}(?!\w)"
    r"|(?<![\w{$])\{[A-Za-z][\w .-]*\}(?!\})"  # {name}
    r"|(?<![\w\[])\[(?!(?:sic|edit|citation needed|\.\.\.|pdf|video|update|ed)\])(?:[A-Za-z][A-Za-z_]*(?: [A-Za-z_]+){0,3})\](?![\](])"  # [name]
    r"|(?<!\S)\?\?(?!\S)"  # ?? km
    r"|(?<![\w%])%(?:s|d|\d\$s)(?!\w)"  # %s
)
_UNITS = ("second", "minute", "hour", "day", "week", "month", "year", "item", "result", "message", "entr", "point", "page", "seat", "room", "copie", "euro", "mile")
_UNIT = rf"(?:{'|'.join(_UNITS)})\w*"
#: Spots that a template filled with nothing or with a missing value, by what may not stand side by side around a gap.
EMPTY_FILL = re.compile(
    r"\w[ \t]+[.,](?=\s|$)"  # a blank before a closing mark: "Dear , thank you", "write to ."
    r"|(?i:(?<!\w)(?:in|by|from|to|at|of|for|with|on|von|bis|mit|par|pour|por|para|per|da|van|voor|från|för)[ \t]{2,}\w)"  # a preposition before a doubled blank
    r"|(?i:(?<!\w)from (?:to|until|till|by|ends?|starts?|begins?|closes?|expires?)(?!\w))"  # from _ to, from _ ends
    r"|(?i:(?<!\w)(?:at|until|between) (?:or|and)(?! (?:near|above|below|beyond|before|after|around|about|under|over|through)(?!\w))(?!\w))"  # at _ or
    r"|(?i:^\w+ (?:in|on|at)) by(?!\w)"  # Posted in _ by Ann
    r"|(?i:^\w+ (?:on|by|at) (?:by|on|at)(?!\w))"  # Written by _ on _
    r"|(?i:\w: (?:incl|excl|net|plus|inkl|zzgl|plus)(?!\w))"  # price: _ incl
    r"|(?i:(?<!\w)(?:ends?|starts?|closes?|opens?|expires?|arrives?|ships?|leaves?|begins?) (?:in|after|within) " + _UNIT + r")"  # ends in _ days
    r"|(?i:(?<!\w)(?:your|the) (?:\w+ )?(?:basket|cart|list|order|inbox|account|box) (?:holds|contains|has) " + _UNIT + r")"  # your basket holds _ items
    r"|(?<!\w)(?:undefined|NaN|\[object Object\])(?=[,.!\s]|$)(?! (?:is|means|was|value|variable|behaviou?r))"
)
#: Every gap of ``EMPTY_FILL`` holds one of these in lower case, "nan" apart; what holds none needs no search.
GAP_HINTS = (
    " ,", " .", "\t", "  ", "undefined", "[object", *(f"from {x}" for x in ("to", "un", "till", "by", "end", "start", "begin", "close", "expire")),
    *(f"{x} {y}" for x in ("at", "until", "between") for y in ("or", "and")), *(f" {x} by" for x in ("in", "on", "at", "by")), *(f" {x} {y}" for x in ("on", "by", "at") for y in ("on", "at")),
    *(f": {x}" for x in ("incl", "excl", "net", "plus", "inkl", "zzgl")), *(f"{x} {u}" for x in ("in", "after", "within", "holds", "contains", "has") for u in _UNITS),
)
DEFAULT_TITLE = re.compile(
    r"^\s*(?:null|undefined|None|NaN|(?i:untitled(?: (?:document|page|post))?|(?:new|sample|test|blank) page|(?:page|document) title|title|insert title(?: here)?)"
    r"|(?:null|undefined|None|NaN)\s*[|\-–:].*|.*[|\-–:]\s*(?:null|undefined))\s*$"
)
# Default texts of page builders and templates, as whole sentences.
DEFAULT_TEXT = re.compile(
    r"(?:your (?:heading|text|title|headline|content|name) (?:goes )?here|(?:add|enter|insert|type|write) your (?:text|content|title)(?: (?:in this box|here))?|double click to edit|click (?:here )?to (?:edit|add text)|image caption(?: placeholder)?|(?:caption|text|title) placeholder|placeholder(?: text)?|"
    r"(?:this is (?:a )?sample (?:paragraph|text|page)|sample text)|replace (?:it|this|me)(?: text)? with .{0,60}|describe your (?:service|product|company) .{0,40}|write something catchy here|item one, item two(?:, item three)?|todo: .{0,60}|tbd|tba|lorem ipsum|"
    r"(?:text ){2,}text|(?:blah ){1,}blah|hier steht ihr text|ihr text hier|votre texte ici|su texto aquí|il tuo testo qui|seu texto aqui|uw tekst hier|tutaj wpisz tekst|din text här)[\s.!…]*",
    re.I,
)
_LATIN = re.compile(
    r"(?:lor[eu]m|ipsum|dolor|sit|amet|consect|adipis|elit|eiusm|tempor|incid|labor|magn|aliqu|veniam|quis|nostr|exerc|ullam|nisi|commod|consequ|duis|aute|irure|repreh|volup|velit|cillum|fugi|null|pariat|except|occaec|cupid|proid|culpa|offici|deserun|molli|laborum|"
    r"sagit|fel[iu]|phar|arcu|lacu|bibend|vest|conval|matt|viver|ligur|orna|nibh|feug|erat|eget|sodal|sapien|naxim|maxim|rhonc|vari|posu|port|praes|tincid|lect|curab|just|curs|facil|semper|vell|augu|ull)\w*"
)
#: Messages of servers, programs and scripts, in the languages of the corpus.
MESSAGE = re.compile(
    r"\b(?:40[0134]|410|429|50[0234])\b.{0,20}\b(?:not found|forbidden|error|unavailable|denied|gone|too many)|(?:page|address|file|document|record|item|listing|url|requested \w+).{0,60}(?:not (?:be )?found|does not exist|has ended|no longer (?:offered|available|exists)|is gone|moved or removed)|could not find what you|no results\b|not found on this server|"
    r"forbidden|access (?:is )?denied|do not have permission|too many requests|sent too many|session has (?:timed out|expired)|sign in again|internal (?:server )?(?:error|failure)|something (?:broke|went wrong)|upstream did not answer|service unavailable|temporarily unavailable|bad gateway|gateway time-?out|"
    r"planned work|down for maintenance|under maintenance|be back (?:shortly|soon)|could not connect|connection refused|database error|warning: \w+\(\)|fatal error|traceback|exception in|errno \d+|template aborted|parse error|"
    r"(?:enable|activate|turn on|switch on|allow|allowing|require|requires|needs?|without|support) (?:for )?(?:javascript|scripts?|cookies)|(?:javascript|scripts?|cookies)(?: and (?:javascript|scripts?|cookies))? (?:is|are|support is) (?:required|disabled|off|needed|blocked)|script support is off|checking your browser|you are human|confirm that you|browser is too old|just a moment|"
    r"aktivieren sie (?:javascript|cookies)|activer (?:javascript|les cookies)|active javascript|attiva(?:re)? javascript|ative o javascript|schakel javascript|włącz javascript|aktivera javascript|"
    r"seite (?:existiert nicht|nicht gefunden|wurde nicht)|existiert nicht mehr|page (?:introuvable|demandée)|n'existe pas|página no encontrada|no hemos encontrado|pagina non trovata|página não encontrada|pagina niet gevonden|nie znaleziono|sidan (?:hittades|finns) inte|zugriff verweigert|accès refusé|acceso denegado",
    re.I | re.S,
)
#: Every message of ``MESSAGE`` holds one of these; what holds none needs no search.
MESSAGE_HINTS = (
    "found", "forbidden", "error", "unavailable", "denied", "gone", "too many", "not exist", "has ended", "no longer", "removed", "could not", "no results", "do not have permission",
    "session has", "sign in again", "internal", "something ", "upstream", "gateway", "planned work", "maintenance", "be back", "refused", "warning: ", "traceback", "exception in", "errno",
    "template aborted", "javascript", "script", "cookies", "checking your", "you are human", "confirm that", "too old", "just a moment", "existiert nicht", "nicht gefunden", "wurde nicht",
    "introuvable", "demandée", "n'existe pas", "no encontrada", "no hemos", "non trovata", "não encontrada", "niet gevonden", "nie znaleziono", "sidan ", "verweigert", "refusé", "denegado",
)
TALK = re.compile(r"\b(?:templates?|placeholders?|syntax|braces?|escap\w+|variables?|expressions?|delimiters?|tokens?|markup|documentation|tutorial|example|dummy copy|calls its|snippet|renders?|prints)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: A message stands instead of content if its sentences hold such a share of the own content's words, however long that is.
MESSAGE_SHARE = 0.15
#: Own content of fewer words, most of it in sentences, is a stub: under error statuses alone it is a message whatever its wording.
STUB_WORDS = 40
PLACE, FILLER, ERROR, TITLE, STUB = "placeholder", "filler", "message", "title", "stub"


def title_residue(title: str | None) -> bool:
    """Whether a title is a placeholder or a default."""
    return bool(title) and (PLACEHOLDER.search(title) is not None or DEFAULT_TITLE.match(title) is not None)


def residue_kind(page: Page, title: str | None) -> str | None:
    """What kind of residue the page is, or null: a placeholder, filler, a message instead of content, or a title of these kinds.

    A stub is none by itself: its documents' statuses decide.
    """
    own = [(page.text[i], page.elem[i]) for i, mine in enumerate(page.label) if mine]
    coded = any(page.tag[e] in CODE_TAGS for _, e in own)
    words = latin = default = message = told = 0
    low = "\n".join(text for text, _ in own).lower()
    hinted = any(h in low for h in MESSAGE_HINTS)
    gaps = any(h in low for h in GAP_HINTS) or any("NaN" in text for text, _ in own)
    for text, e in own:
        if page.tag[e] in CODE_TAGS:
            continue
        n = text.count(" ") + 1
        words += n
        if any(c in text for c in "{}[]$<%@#_?"):
            for hit in PLACEHOLDER.finditer(text):
                around = text[max(0, hit.start() - 1) : hit.start()] + text[hit.end() : hit.end() + 1]
                if around in ('""', "''", "``", "“”", "‘’", "«»", "„“"):
                    continue
                start = max(text.rfind(". ", 0, hit.start()), text.rfind("? ", 0, hit.start()), 0)
                stop = text.find(". ", hit.end())
                if coded and TALK.search(text[start : stop if stop > 0 else len(text)]):
                    continue
                return PLACE
        if gaps and EMPTY_FILL.search(text):
            return PLACE
        for sentence in _SENTENCE.split(text) if n > 1 else (text,):
            if DEFAULT_TEXT.match(sentence) is not None:
                rest = sentence
                while rest and (m := DEFAULT_TEXT.match(rest)):
                    rest = rest[m.end() :].lstrip()
                if not rest or rest[:1].isupper():
                    default += 1
            m = sentence.count(" ") + 1
            if m >= 4 and sentence[-1] in ".!?…":
                told += m
            if hinted and MESSAGE.search(sentence) is not None:
                message += m
            if m >= 2 and sum(1 for w in sentence.lower().split() if _LATIN.match(w)) >= 0.6 * m:
                latin += m
    if default or (words and latin >= 0.3 * words and latin >= 8):
        return FILLER
    if words and message >= MESSAGE_SHARE * words:
        return ERROR
    if title_residue(title):
        return TITLE
    return STUB if 0 < words < STUB_WORDS and 2 * told > words else None


def plain_page(text: str) -> Page:
    """A plain-text body as a page whose lines are all own content."""
    page = Page("")
    page.text = [x.strip() for x in text.splitlines() if x.strip()]
    page.elem = [0] * len(page.text)
    page.label = [True] * len(page.text)
    return page


def residue_bodies(bodies: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(content_hash, kind) of the stored bodies whose title or own content is residue or a stub; a body stored twice may come twice.

    Input: content_hash, body, content_type. A null hash gives no row; a null, empty or unreadable body has no text and gives no
    row; a body that isn't HTML counts as own content as a whole, but no message stands in it; very long bodies are read to their end.
    Without a ``model`` for the own content one is fitted on a sample of the bodies.
    """
    model = model or fitted_model(bodies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, body, ct, html in zip(batch.content_hash, batch.body, batch.content_type, batch.html):
                text = page_text(body, ct)
                if html:
                    kind = residue_kind(label_page(text, model), title_of(text))
                else:
                    kind = residue_kind(plain_page(text), None)
                    kind = None if kind in (ERROR, STUB) else kind
                if kind:
                    out.append((h, kind))
            yield pd.DataFrame(out, columns=["content_hash", "kind"])

    kept = bodies.where(bodies["content_hash"].isNotNull() & bodies["body"].isNotNull())
    return spread(kept.select("content_hash", "body", "content_type", is_html(bodies["content_type"]).alias("html"))).mapInPandas(run, "content_hash string, kind string")


def residue_documents(document: DataFrame, bodies: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(document_id) of every document with a stored body that is residue, or with a stored body and a title that is.

    A stub counts if every known http_status of its documents is an error. Every URL that shares the body counts; ids come once, however
    often a row is repeated; a null id or hash gives no row. The flagged hashes are few, the documents may hold one hash on a third of
    all rows: statuses are aggregated per hash before they meet the stubs, and AQE splits that partition of the semi join.
    """
    docs = document.select("id", "content_hash", "title", "http_status").where(F.col("id").isNotNull() & F.col("content_hash").isNotNull())
    found = residue_bodies(bodies, model)
    good = docs.groupBy("content_hash").agg(F.coalesce(F.min("http_status") >= 400, F.lit(False)).alias("failed"))
    flagged = found.groupBy("content_hash").agg(F.min(F.col("kind") == STUB).alias("stub")).join(good, "content_hash").where(~F.col("stub") | F.col("failed"))
    by_body = docs.join(flagged, "content_hash", "left_semi").select("id")
    titled = docs.where(F.col("title").rlike(PLACEHOLDER.pattern) | F.col("title").rlike(DEFAULT_TITLE.pattern))
    by_title = titled.join(bodies.select("content_hash"), "content_hash", "left_semi").select("id")
    return by_body.unionAll(by_title).distinct().select(F.col("id").alias("document_id"))
