"""Problem 3: the main body of pages by minimum-cut labelling.

A logistic classifier over words, shapes and neighbours prices each line. The prices are terminal
capacities of a flow network; edges between adjacent lines, and between near lines of the same
shape (extracted text has no DOM, so shape and distance stand in for it), resist a change of label. The minimum cut
separates body from boilerplate.

The classifier learns from a bounded sample of pages (`sample_pages`, default 2500). Weak rules (wording common on the web,
lines that recur over pages, side boxes, running text) label a part of the lines; in rounds, a model and its cut label the rest for the next one.

Nulls: rows without id or content are left out; a null title matches no line. Empty texts have no
lines. Repeated rows of a record count once.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm import blocks as B, page_lines as P

# Weak rules: wording that web pages of any kind have around their text, in the languages of `languages.LANGUAGES`. The first
# holds for lines of up to `long_words`, the second for short ones, the third for headings of side boxes.
_NOTICES = (
    "cookie", "cookies", "privacy policy", "privacy notice", "privacy settings", "your privacy", "data protection", "terms of use", "terms of service", "terms and conditions", "all rights reserved", "copyright 0", "copyright ©", "copyright notice", "©", "(c) 0", "disclaimer", "legal notice", "no responsibility", "accept no liability", "external links", "reproduced without permission",
    "skip to content", "skip to main", "skip navigation", "back to top", "return to top", "go to top", "scroll to top", "site map", "sitemap", "print this page", "printer friendly", "email this page", "send this page", "send to a friend", "share this", "share on", "share via", "tell a friend", "follow us", "like us", "find us on", "join us on", "subscribe to", "sign up for", "newsletter", "get updates", "download our app", "download the app",
    "you are here", "read more", "learn more", "click here", "load more", "show more", "view all", "see all", "next page", "previous page", "page 0 of 0", "was this page", "was this helpful", "rate this", "report a problem", "report an error", "leave a comment", "leave a reply", "add a comment", "post a comment", "give feedback", "chat with us", "contact us", "about us",
    "posted by", "posted on", "posted in", "published by", "published on", "written by", "edited by", "reviewed by", "submitted by", "uploaded by", "photo by", "filed under", "last updated", "last modified", "last reviewed", "updated on", "page updated", "min read", "powered by", "hosted by", "designed by", "developed by", "maintained by", "best viewed", "screen reader", "text size", "font size", "high contrast", "total visitors", "visitor number", "page views",
    "log in", "sign in", "forgot password", "forgot your password", "search this site", "search the site", "select language", "choose language", "skip this ad", "opening hours",
    "datenschutz", "impressum", "alle rechte vorbehalten", "nach oben", "zum inhalt springen", "zuletzt geändert", "zuletzt aktualisiert", "seite drucken", "seite teilen", "folgen sie uns", "mentions légales", "politique de confidentialité", "tous droits réservés", "retour en haut", "haut de page", "aller au contenu", "dernière mise à jour", "imprimer cette page", "partager cette page", "suivez-nous", "publié par", "publié le",
    "aviso legal", "política de privacidad", "todos los derechos reservados", "volver arriba", "ir al contenido", "última actualización", "imprimir esta página", "compartir esta página", "síguenos", "publicado por", "política de privacidade", "todos os direitos reservados", "voltar ao topo", "ir para o conteúdo", "última atualização", "imprimir esta página", "partilhar esta página", "compartilhar", "siga-nos",
    "सर्वाधिकार सुरक्षित", "गोपनीयता नीति", "मुख्य सामग्री पर जाएं", "अंतिम अद्यतन", "साझा करें", "कुकीज़", "कुकी", "सर्व हक्क सुरक्षित", "गोपनीयता धोरण", "मुख्य मजकुराकडे जा", "शेवटचे अद्यतन", "शेअर करा", "कुकीज",
)
_CONTROLS = (
    "home", "menu", "main menu", "navigation", "search", "login", "logout", "register", "sign up", "my account", "help", "help desk", "faq", "feedback", "contact", "contacts", "about", "news", "events", "calendar", "gallery", "downloads", "careers", "jobs", "library", "alumni", "staff", "webmail", "intranet", "directory", "archive", "archives", "press", "media", "publications", "tenders", "notices", "students", "admissions", "academics", "departments", "research", "facilities", "accessibility", "language", "english", "print", "share", "bookmark", "subscribe", "follow", "tweet", "like", "comments", "close", "open", "expand", "collapse", "expand all", "collapse all", "previous", "next", "first", "last", "top", "up", "back", "continue", "loading", "advertisement", "sponsored", "ads", "rss", "facebook", "twitter", "linkedin", "instagram", "youtube", "whatsapp", "telegram", "mail", "email", "permalink", "cart", "basket", "map", "older posts", "newer posts", "settings", "preferences", "accept", "accept all", "reject all", "ok",
    "startseite", "suche", "anmelden", "kontakt", "hilfe", "drucken", "teilen", "weiter", "zurück", "accueil", "rechercher", "connexion", "aide", "imprimer", "partager", "suivant", "précédent", "inicio", "buscar", "ayuda", "contacto", "compartir", "siguiente", "anterior", "início", "pesquisar", "ajuda", "contato", "partilhar", "imprimir", "मुखपृष्ठ", "मुख्य पृष्ठ", "खोजें", "संपर्क", "सहायता", "हिन्दी", "शोधा", "मदत", "मराठी",
)
_BOXES = ("quick links", "useful links", "important links", "links", "related links", "related pages", "related posts", "related articles", "related stories", "related news", "related topics", "related content", "see also", "further reading", "read next", "more like this", "more from", "more on", "in this section", "on this page", "in this issue", "most read", "most viewed", "most popular", "popular", "popular posts", "popular pages", "trending", "trending now", "recommended", "recommended for you", "you may also like", "you might also like", "recent posts", "recent comments", "recent news", "latest", "latest news", "latest posts", "latest from", "upcoming", "upcoming events", "events calendar", "notice board", "noticeboard", "announcements", "what's new", "highlights", "tags", "tag cloud", "categories", "topics", "archives", "sitemap", "follow us", "share this", "connect with us", "elsewhere", "sponsors", "advertisement", "on this day")


def _pattern(phrases: tuple[str, ...]) -> str:
    return "|".join(re.escape(x) for x in sorted(set(phrases), key=len, reverse=True))


_NOTICE = re.compile(rf"(?<!\w)(?:{_pattern(_NOTICES)})(?!\w)")
_CONTROL = re.compile(rf"(?:{_pattern(_CONTROLS)})(?:\W.*)?$")
_BOX = re.compile(rf"(?:{_pattern(_BOXES)})(?: (?:of|from|in|on|for) .{{1,40}}| this (?:week|month|year))?:?$")


@dataclass(frozen=True)
class Settings:
    """sample_pages bounds the pages that train the classifier, in `rounds`. recurrent: least share of the sample in which a line that
    is no running text recurs to count as furniture. trust: log-odds of a weak label. Edge weights are in units of log-odds."""

    sample_pages: int = 2500
    rounds: int = 2
    long_words: int = 32
    short_words: int = 4
    recurrent: float = 0.004
    adjacent: float = 1.0
    across_blank: float = 0.4
    shape_change: float = 0.25
    proximity: float = 0.4
    clip: float = 6.0
    bias: float = 0.0
    trust: float = 0.5


def edges(p: P.Page, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacency and proximity edges (i, j, weight) between lines of a text."""
    n = len(p)
    i = np.arange(max(0, n - 1))
    same = p.doc[i] == p.doc[i + 1] if n > 1 else np.zeros(0, bool)
    i = i[same]
    alike = p.sentence[i] == p.sentence[i + 1]
    w = np.where(alike, s.adjacent, s.shape_change) * np.where(p.gap[i + 1] > 0, s.across_blank, 1.0)
    k = np.arange(max(0, n - 2))
    kind = p.shape["bullet"] * 8 + p.shape["counted"] * 4 + p.shape["dated"] * 2 + (p.sentence * 1) if n else np.zeros(0)
    near = (p.doc[k] == p.doc[k + 2]) & (kind[k] == kind[k + 2]) & (p.no[k + 2] - p.no[k] <= 3) & ~p.sentence[k] if n > 2 else np.zeros(0, bool)
    k = k[near]
    return np.concatenate([i, k]), np.concatenate([i + 1, k + 2]), np.concatenate([w, np.full(len(k), s.proximity)])


def min_cut(cost: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Labels x in {0, 1} that minimize sum(max(cost, 0) [x = 0] + max(-cost, 0) [x = 1]) + sum(w [x_a != x_b]).

    A node whose terminal capacity is at least the sum of its edges keeps its terminal's side in some
    minimum cut; it is merged into the terminal and its edges become capacities of its neighbours.
    What this leaves, mostly nothing or a few lines of a page, is solved by maximum flow (breadth-first augmenting paths).
    """
    n = len(cost)
    cost = cost.astype(float).copy()
    label = np.full(n, -1)
    live = np.ones(len(a), bool)
    while True:
        load = np.bincount(a[live], weights=w[live], minlength=n) + np.bincount(b[live], weights=w[live], minlength=n)
        fix = (label < 0) & (np.abs(cost) >= load)
        if not fix.any():
            break
        label[fix] = cost[fix] > 0
        la, lb = label[a], label[b]
        pa_, pb_ = live & (la >= 0) & (lb < 0), live & (lb >= 0) & (la < 0)
        np.add.at(cost, b[pa_], np.where(la[pa_] == 1, w[pa_], -w[pa_]))
        np.add.at(cost, a[pb_], np.where(lb[pb_] == 1, w[pb_], -w[pb_]))
        live &= (la < 0) & (lb < 0)
    rest = np.flatnonzero(label < 0)
    if len(rest):
        _flow(cost, a[live], b[live], w[live], rest, label)
    return label


def _flow(cost: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, rest: np.ndarray, label: np.ndarray) -> None:
    index = {int(v): i for i, v in enumerate(rest)}
    n = len(rest)
    source, sink = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def connect(u: int, v: int, forth: float, back: float) -> None:
        graph[u][v] = graph[u].get(v, 0.0) + forth
        graph[v][u] = graph[v].get(u, 0.0) + back

    for v, i in index.items():
        c = cost[v]
        connect(source, i, max(c, 0.0), 0.0)
        connect(i, sink, max(-c, 0.0), 0.0)
    for u, v, x in zip(a.tolist(), b.tolist(), w.tolist()):
        connect(index[u], index[v], x, x)
    while True:
        parent, queue = {source: source}, deque([source])
        while queue and sink not in parent:
            u = queue.popleft()
            for v, left in graph[u].items():
                if left > 1e-9 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            break
        path, v = [], sink
        while v != source:
            path.append((parent[v], v))
            v = parent[v]
        push = min(graph[u][v] for u, v in path)
        for u, v in path:
            graph[u][v] -= push
            graph[v][u] += push
    for v, i in index.items():
        label[v] = 1 if i in parent else 0


def cut_lines(p: P.Page, z: np.ndarray, s: Settings) -> np.ndarray:
    """1 for boilerplate, 0 for body, of each line."""
    if not len(p):
        return np.zeros(0, np.int64)
    return min_cut(np.clip(z + s.bias, -s.clip, s.clip), *edges(p, s))


def _weak_labels(p: P.Page, titles: np.ndarray, s: Settings) -> np.ndarray:
    """1 furniture, 0 body, -1 unknown; by wording, recurrence, boxes and running text."""
    n = len(p)
    text = [re.sub(r"\s+", " ", re.sub(r"\d+", "0", bytes(p.low[a:b]).decode("utf-8", "replace"))).strip(" .!") for a, b in zip(p.start, p.end)]
    key = p.line_keys()
    uniq, inverse = np.unique(key, return_inverse=True)
    pairs = np.unique(np.stack([inverse, p.doc], 1), axis=0)
    df = np.bincount(pairs[:, 0], minlength=len(uniq))[inverse] / max(1, p.n_docs)
    y = np.full(n, -1)
    furniture = np.array([bool(_NOTICE.search(t)) for t in text], bool)
    furniture |= (p.n_words <= s.short_words) & (p.shape["stop"] == 0) & np.array([bool(_CONTROL.match(t)) for t in text], bool)
    title_like = np.array([bool(_BOX.match(t)) for t in text], bool)
    long = p.sentence & (p.n_words >= 6)
    y[long | (p.shape["answer"] == 1)] = 0
    seps = (p.shape["separators"] >= 2) & ~p.sentence & (p.n_words <= 30) & (p.shape["digits"] == 0)
    y[furniture & (~long | (p.n_words <= s.long_words))] = 1
    y[(df > 0.01) & (df * p.n_docs >= 5) & (p.n_words <= 3) & (p.n_tok > 0) & (p.shape["stop"] == 0) & (p.shape["numbered"] == 0) & (p.shape["bullet"] == 0) & (p.shape["colon"] == 0) & ~np.array([(":" in t) or ("=" in t) for t in text], bool)] = 1
    # what recurs over many pages though it is longer, running text too: notices
    seen = df * p.n_docs
    often = (seen >= np.maximum(5, s.recurrent * p.n_docs)) & (p.n_words >= 4) & ((p.shape["numbered"] == 0) | (p.n_words >= 8))
    own, back = p.per_doc(p.n_words * (long & ~often)), p.per_doc(p.n_words * (long & often))
    beside = ((own > 0) & (own >= back))[p.doc]  # a page most of whose text recurs has no other body
    notice = often & beside & (np.bincount(inverse, weights=beside)[inverse] >= 0.5 * np.bincount(inverse)[inverse])
    # some of its places are at the ends of a page or next to other furniture, or the model decides
    end = np.ones(n, bool)
    end[2:-2] = (p.doc[2:-2] != p.doc[:-4]) | (p.doc[2:-2] != p.doc[4:])
    mark = np.pad((y == 1).astype(int), 1)
    outer = np.bincount(inverse, weights=notice & (~long | end | (mark[:-2] + mark[2:] > 0)))[inverse]
    y[notice] = np.where(outer >= 0.1 * np.bincount(inverse, weights=notice)[inverse], 1, -1)[notice]
    y[title_like] = 1
    has = np.bincount(p.doc[y == 1], minlength=p.n_docs) > 0
    running = p.per_doc(long) > 0
    y[seps & (running | has)[p.doc]] = 1
    tail = np.zeros(n, np.uint64)
    tail[p.tok_line] = p.tok_hash
    y[(p.shape["separators"] > 0) & (tail == titles[1][p.doc]) & (tail != 0) & (p.n_words <= 25) & (p.shape["digits"] == 0)] = 1
    # a box goes on from its heading over short lines without a gap
    inside = False
    for i in range(n):
        if title_like[i]:
            inside = True
        elif inside and p.gap[i] == 0 and not p.sentence[i] and p.n_words[i] <= 10 and not p.shape["stop"][i] and p.shape["bullet"][i] != 4:
            nxt = i + 1 < n and p.gap[i + 1] == 0 and p.sentence[i + 1]
            if y[i] < 0 and (not nxt or p.shape["bullet"][i] or p.shape["counted"][i] or p.shape["dated"][i]):
                y[i] = 1
            if nxt:
                inside = False
        else:
            inside = False
    # runs of one bullet between running text are lists of the body
    kind = p.shape["bullet"] * 2 + (p.shape["numbered"] > 0)
    i = 0
    while i < n:
        j = i + 1
        while j < n and p.doc[j] == p.doc[i] and kind[j] == kind[i] and not p.sentence[j] and p.gap[j] == 0:
            j += 1
        if j - i >= 4 and not p.sentence[i] and (p.shape["numbered"][i] or p.shape["bullet"][i] == 5) and not p.shape["colon"][i]:
            y[i:j] = 0
        elif j - i >= 4 and not p.sentence[i] and i and j < n and p.doc[i - 1] == p.doc[i] == p.doc[j] and p.sentence[i - 1] and p.sentence[j] and not (y[i:j] == 1).any():
            y[i:j] = 0
        i = j
    # records with neither running text nor two signs of furniture are all body, as are very short ones
    lines = p.per_doc(np.ones(n))
    marks = p.per_doc((y == 1) & (p.n_tok > 0))
    whole = ((~running) & (marks < 0.25 * lines)) | (lines <= 3)
    y[whole[p.doc]] = 0
    # short lines right before running text in records that open with it are headings
    nx = np.minimum(np.arange(n) + 1, n - 1)
    alone = (y < 0) & p.sentence[nx] & (p.doc[nx] == p.doc) & (p.n_words <= 10)
    pv = np.maximum(np.arange(n) - 1, 0)
    alone &= (p.sentence[pv] & (p.doc[pv] == p.doc)) | (p.gap == 99)
    y[alone] = 0
    fragment = (y < 0) & (p.gap == 0) & p.sentence[pv] & (p.shape["stop"][pv] == 0) & (p.n_words[pv] >= 6) & ((p.shape["stop"] == 1) | (p.n_words > 5))
    y[fragment] = 0
    return y


def is_title(p: P.Page, keys: np.ndarray) -> np.ndarray:
    """Lines of at least two words that repeat the record's title."""
    return (keys[0][p.doc] == p.line_keys()) & (keys[0][p.doc] != 0) & (p.n_tok >= 2)


def train(texts: list[str], titles: list[str | None], common: list[str], s: Settings = Settings()) -> np.ndarray:
    """Classifier weights from a sample of pages."""
    p = P.Page.of([t.encode("utf-8", "replace") for t in texts], P.word_hashes(common))
    keys = P.title_keys([(t or "").encode() for t in titles])
    if not len(p):
        return np.zeros(1 << P.SPACE_BITS, np.float32)
    y = _weak_labels(p, keys, s)
    y[is_title(p, keys)] = 0
    at, key = P.features(p, keys)
    x, weight = np.maximum(y, 0), (y >= 0) * 1.0
    for _ in range(s.rounds):
        w = P.fit_logistic(at, key, x, weight)
        z = np.bincount(at, weights=w[key], minlength=len(p))
        x = cut_lines(p, np.where(y < 0, z, np.where(y == 1, np.maximum(z, s.trust), np.minimum(z, -s.trust))), s)
        weight = np.where(y < 0, 0.5, 1.0)
    return P.fit_logistic(at, key, x, weight)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    common: np.ndarray
    settings: Settings

    def label(self, texts: list[bytes], titles: list[bytes]) -> tuple[P.Page, np.ndarray]:
        """Lines of the texts and 1 for those outside the body. A line that is the title is tied to the body."""
        p = P.Page.of(texts, self.common)
        keys = P.title_keys(titles)
        z = P.logits(self.weights, p, keys)
        if len(p):
            z[is_title(p, keys)] = -2 * self.settings.clip
        return p, cut_lines(p, z, self.settings)


def sample(records: DataFrame, n: int, most_chars: int = 50_000) -> list:
    """At most `n` records of at most `most_chars` characters to learn from, the same ones for the same data: those with the
    smallest hashes of id among about 2n candidates."""
    total = records.select("id").count()
    every = max(1, total // (2 * n))
    picked = records.where((F.pmod(F.xxhash64("id"), F.lit(every)) == 0) & (F.length("content") <= most_chars))
    return picked.orderBy(F.xxhash64("id", F.lit(7)), "id", "content").select("id", "title", "declared_lang", "content").limit(n).collect()


def fit(records: DataFrame, common: list[str], s: Settings = Settings(), rows: list | None = None) -> Model:
    rows = sample(records, s.sample_pages) if rows is None else rows
    w = train([r.content for r in rows], [r.title for r in rows], common, s)
    return Model(w, P.word_hashes(common), s)


def text_batches(batch: pa.RecordBatch, content: int = 1, title: int = 2) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    texts, titles = batch.column(content), batch.column(title)
    for lo, hi in B.text_chunks(texts):
        yield lo, [t.encode("utf-8", "replace") for t in texts.slice(lo, hi - lo).to_pylist()], [(t or "").encode() for t in titles.slice(lo, hi - lo).to_pylist()]


def _mark(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts, titles in text_batches(batch):
                p, x = model.label(texts, titles)
                out = np.flatnonzero(x == 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(p.doc[out] + lo)), pa.array(p.no[out].astype(np.int64))], ["id", "line_no"])

    return run


def boilerplate_lines(records: DataFrame, common: list[str], s: Settings = Settings()) -> DataFrame:
    """id, line_no of the non-blank lines outside the main body."""
    rows = records.where("id is not null and content is not null")
    model = fit(rows, common, s)
    return rows.select("id", "content", "title").mapInArrow(_mark(model), "id string, line_no bigint").distinct()
