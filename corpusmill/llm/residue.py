"""Problem 5: template residue, filler and error pages by character n-gram models.

Hashed n-gram models are fitted for filler and stand-in text, for error and script notices, for unfilled placeholders, and for
everything else. The log-likelihood ratio per byte localises residue: lines whose mean ratio is high are residue text;
windows of a high ratio are placeholders. Placeholders are modelled twice, by their characters and by their shape (letters and digits
stand for their class), so a field name never seen before in a notation that is known scores as high as a known one. Whether the
words around a placeholder read like writing about placeholders is told by a model of such writing. A record is
excluded by coverage: error text over at least `error_cover` of it, or at least `residue_bytes` of filler or stand-in text, or
at least `mark_bytes` of placeholders.

The models start from the seed phrases below, which are common knowledge of web publishing, and from notations of public
template languages filled with common field names. Then they learn from all records in rounds: what the models of one round find is residue to
the next, and what stands in records that are mostly error text, too. A round reads the records twice: for the lines it finds, and for every
place of these lines, whose n-grams are taken out of the count of all text. To the driver come histograms of fixed size and a hash of each
distinct line found.

Nulls: rows without id or content are left out. Empty texts have no residue. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm import blocks as B

BITS = 18
ORDER = 5

# The printer's and web designers' usual filler texts.
FILLER_SEEDS = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos.",
    "Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor. Maecenas faucibus mollis interdum. Nullam quis risus eget urna mollis ornare vel eu leo.",
)
STAND_IN_SEEDS = (
    "Far far away, behind the word mountains, far from the countries Vokalia and Consonantia, there live the blind texts.",
    "Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte.",
    "The quick brown fox jumps over the lazy dog.", "Li Europan lingues es membres del sam familie.", "asdf asdf asdf asdf", "qwerty qwerty qwerty", "bla bla bla bla bla", "foo bar baz qux",
    "This is sample text.", "This is dummy text.", "This is a placeholder.", "Placeholder text", "Dummy text", "Sample text", "Sample page", "Sample title", "Sample heading", "Sample content", "Example heading",
    "Your text here", "Your text goes here", "Your title here", "Your heading here", "Your content here", "Your name here", "Your logo here", "Your caption here", "Add text here", "Add your text here", "Add a short description here",
    "Add content here", "Add a title", "Add a subtitle", "Insert text here", "Insert content here", "Insert image here", "Insert title here", "Insert caption here", "Enter text here", "Enter your text here", "Type your text here", "Write your text here", "Write something here", "Write a description here",
    "Text goes here", "Title goes here", "Heading goes here", "Content goes here", "Body goes here", "Caption goes here", "Description goes here", "The text will be placed here", "The content will be added here later", "Introduction will be added here", "Summary will come here", "Details will be added soon",
    "Click here to edit this text", "Double click to edit", "Click to add title", "Click to add text", "Edit this text", "Replace this text with your own.", "Replace this with your own words.", "Delete this text and write your own.", "I am a paragraph. Click here to add your own text and edit me.", "This is a paragraph. Use this space to tell people more about your site.",
    "Hello world! Welcome to your new site. This is your first post. Edit or delete it, then start writing!", "Just another blog", "This is an example page.", "Coming soon", "Content coming soon", "More content coming soon", "Page under construction", "This page is under construction.", "This section is under construction.", "Under construction, please check back later.", "To be added", "To be announced", "To be updated", "To be filled in", "Text to follow", "Text to be supplied", "Copy to come",
    "Hier steht ein Beispieltext.", "Blindtext", "Platzhaltertext", "Text folgt", "Hier kommt Ihr Text hin.", "Inhalt folgt in Kürze", "Diese Seite befindet sich im Aufbau.", "Ceci est un texte d'exemple.", "Texte à venir", "Votre texte ici", "Insérez votre texte ici", "Page en construction", "Contenu à venir", "Faux texte", "Este es un texto de ejemplo.", "Texto de relleno", "Su texto aquí", "Escriba su texto aquí", "Página en construcción", "Próximamente", "Este é um texto de exemplo.", "Seu texto aqui", "Digite seu texto aqui", "Página em construção", "Em breve", "Conteúdo em breve",
    "यहाँ अपना पाठ लिखें", "यह एक नमूना पाठ है।", "नमूना पाठ", "जल्द आ रहा है", "पृष्ठ निर्माणाधीन है", "येथे आपला मजकूर लिहा", "हा नमुना मजकूर आहे.", "नमुना मजकूर", "लवकरच येत आहे", "पान निर्माणाधीन आहे",
)
# What servers, frameworks and browsers say.
ERROR_SEEDS = (
    "404 Not Found", "Error 404", "404 - Page not found", "404 File or directory not found.", "Page not found", "The page you requested could not be found.", "The page you are looking for does not exist.", "The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.", "Sorry, the page you were looking for was not found.", "Oops! That page can't be found.", "It looks like nothing was found at this location.", "The requested URL was not found on this server.", "We could not find the page you requested. It may have been moved or deleted.", "This page no longer exists.", "The link you followed may be broken, or the page may have been removed.", "Please check the URL and try again.", "Go back to the home page.", "Return to the homepage or use the search.",
    "400 Bad Request", "Your browser sent a request that this server could not understand.", "401 Unauthorized", "You must log in to view this page.", "403 Forbidden", "You don't have permission to access this resource on this server.", "Access denied", "You are not authorized to view this page.", "405 Method Not Allowed", "408 Request Timeout", "410 Gone", "The requested resource is no longer available on this server.", "429 Too Many Requests", "You have sent too many requests in a given amount of time. Please wait and try again.",
    "500 Internal Server Error", "The server encountered an internal error or misconfiguration and was unable to complete your request.", "Something went wrong. Please try again later.", "An unexpected error occurred.", "An error occurred while processing your request.", "502 Bad Gateway", "The proxy server received an invalid response from an upstream server.", "503 Service Unavailable", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.", "The site is down for maintenance. Please come back soon.", "Briefly unavailable for scheduled maintenance. Check back in a minute.", "504 Gateway Timeout", "The upstream server is timing out.", "The connection has timed out.", "This site can't be reached", "The server took too long to respond.", "The request timed out.", "Please contact the administrator and inform them of the time the error occurred.", "More information about this error may be available in the server error log.", "Reference number of the error: 000000", "Incident ID: 0000", "nginx", "Apache Server at port 80",
    "Error establishing a database connection", "Could not connect to the database: too many connections", "Connection refused", "Database error", "SQLSTATE[HY000]: General error: server has gone away", "Warning: mysql_connect(): Access denied for user", "Warning: include(): failed to open stream: No such file or directory in index.php on line 12", "Fatal error: Call to undefined function in functions.php on line 10", "Fatal error: Uncaught exception thrown in on line 1", "Fatal error: Allowed memory size exhausted", "Notice: Undefined index in on line", "Parse error: syntax error, unexpected end of file", "Traceback (most recent call last): File line in module", "Exception in thread main java.lang.NullPointerException", "HTTP Status 500 - Internal Server Error", "Server Error in Application. Runtime Error", "Whitelabel Error Page. This application has no explicit mapping for error", "TemplateDoesNotExist", "Template not found", "Segmentation fault", "Stack trace:",
    "Your session has expired. Please log in again.", "Session timed out. Please sign in again to continue.", "Your session has ended due to inactivity.", "The file you requested is not available.", "The document could not be loaded.", "The document could not be opened.", "This content is not available.", "This content is no longer available.", "The file is damaged and could not be repaired.", "Unable to load the page. Check your connection and reload.", "Failed to load resource", "Index of / Name Last modified Size Description Parent Directory", "This domain is for sale. This account has been suspended.", "Your access to this site has been limited.", "Sorry, you have been blocked. You are unable to access this site.",
    "Please enable JavaScript", "Please enable JavaScript to continue using this application.", "You need to enable JavaScript to run this app.", "This site requires JavaScript to work properly.", "This page requires JavaScript. Please turn it on in your browser settings and reload.", "JavaScript is disabled in your browser. Please enable JavaScript to use this site.", "JavaScript must be enabled in order to view this page.", "JavaScript is required to view this content.", "It appears that JavaScript is not enabled in your browser.", "Your browser does not support JavaScript.", "Your browser does not support scripts, or scripts are blocked.", "Scripts are required for this page to work. Allow scripts and reload the page.", "Some features of this site will not work without scripts.", "For full functionality of this site it is necessary to enable JavaScript.", "Enable JavaScript and cookies to continue", "Please turn JavaScript on and reload the page.", "Please disable your ad blocker and reload the page.", "Checking your browser before accessing the site.", "Checking if the site connection is secure. This process is automatic. Your browser will redirect to your requested content shortly.", "Please wait while we verify your browser.", "Verify you are human by completing the action below.", "Loading, please wait...", "Loading... If the page does not load, enable JavaScript.", "Your browser is out of date. Please update your browser to view this site.", "This browser is not supported.",
    "Seite nicht gefunden", "Die angeforderte Seite wurde nicht gefunden.", "Die gewünschte Seite existiert nicht.", "Zugriff verweigert", "Interner Serverfehler", "Der Dienst ist vorübergehend nicht verfügbar.", "Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Diese Seite benötigt JavaScript.", "Zum Anzeigen dieser Seite muss JavaScript aktiviert sein.",
    "Page non trouvée", "Page introuvable", "La page que vous cherchez n'existe pas ou a été déplacée.", "La page demandée est introuvable.", "Accès refusé", "Erreur interne du serveur", "Le service est temporairement indisponible.", "Une erreur est survenue. Veuillez réessayer plus tard.", "Votre session a expiré. Veuillez vous reconnecter.", "Veuillez activer JavaScript dans votre navigateur.", "Ce site nécessite JavaScript pour fonctionner.", "JavaScript est désactivé dans votre navigateur.",
    "Página no encontrada", "La página que busca no existe o ha sido movida.", "No se ha encontrado la página solicitada.", "Acceso denegado", "Error interno del servidor", "El servicio no está disponible temporalmente.", "Se ha producido un error. Inténtelo de nuevo más tarde.", "Su sesión ha caducado. Inicie sesión de nuevo.", "Por favor, active JavaScript en su navegador.", "Este sitio requiere JavaScript.", "JavaScript está desactivado en su navegador.",
    "Página não encontrada", "A página que você procura não existe ou foi movida.", "A página solicitada não foi encontrada.", "Acesso negado", "Erro interno do servidor", "O serviço está temporariamente indisponível.", "Ocorreu um erro. Tente novamente mais tarde.", "Sua sessão expirou. Entre novamente.", "Por favor, ative o JavaScript no seu navegador.", "Este site requer JavaScript.", "O JavaScript está desativado no seu navegador.",
    "पृष्ठ नहीं मिला", "आप जो पृष्ठ खोज रहे हैं वह मौजूद नहीं है।", "प्रवेश निषेध", "आंतरिक सर्वर त्रुटि", "सेवा अस्थायी रूप से अनुपलब्ध है।", "कोई त्रुटि हुई। कृपया बाद में पुनः प्रयास करें।", "आपका सत्र समाप्त हो गया है।", "कृपया अपने ब्राउज़र में जावास्क्रिप्ट सक्षम करें।", "पान सापडले नाही", "आपण शोधत असलेले पान अस्तित्वात नाही.", "प्रवेश नाकारला", "सेवा तात्पुरती उपलब्ध नाही.", "काहीतरी चूक झाली. कृपया नंतर पुन्हा प्रयत्न करा.", "आपले सत्र संपले आहे.", "कृपया आपल्या ब्राउझरमध्ये जावास्क्रिप्ट सुरू करा.",
)
# Writing about placeholders and errors, as manuals and lessons have it.
MENTION_SEEDS = (
    "In the template language a variable is written between double braces, for example {{ user }}, and is replaced by its value when the page is rendered.", "The placeholder %s stands for a string, and %d for a number.", "The syntax ${variable} expands to the value of the variable in the shell.", "Tags such as <div> and <span> group other elements of a page.", "The notation [x] means that the argument is optional.",
    "Students learn how a form letter replaces a field like [Name] with an entry of the address list.", "This chapter explains what the expression <%= value %> prints and why it should be escaped.", "In the documentation, words in angle brackets, such as <file>, are to be replaced by the reader.", "The tutorial shows how the merge field is filled from the table.", "A block like {% for item in list %} is called a loop; the engine repeats its body.", "In this example, the string %PATH% refers to an environment variable.", "Authors often use the marker TODO: in comments, which the tool then lists.",
)
# Ordinary uses of the signs that notations are made of.
ORDINARY_SEEDS = (
    "as was shown before [1] and [2, 3]", "in the report [see table 2 and note 3] it is said", "(see table 2 [and note 3])", "the author [and others] of the book", "he said [in a letter] that", "the interval [0, 1] and the set {1, 2, 3}", "if a < b and b > c then", "f(x) = {a, b}", "about 50 % of 100 $ and 20 %", "# 1 of 20, C# and F#", "(in a note) and (for the year 2020)", "a & b, c | d, e * f", "the array a[i] and b[j]",
    "<b>bold</b> and <i>italic</i>", "<td>cell</td><td>cell</td>", "<p>text</p>", "<br>", "<hr>", "<div>", "<tr>", "<li>item</li>", "<ul>", "<b> and </b>", "<span>", "</table>", "<em>word</em>",
)
_FIELDS = ("title", "name", "date", "author", "summary", "body", "amount", "department", "heading", "email", "address", "description", "phone", "place", "year", "code", "number", "image", "link", "url", "city", "street", "time", "section", "item", "caption", "user", "id", "first_name", "last_name", "full name", "office", "text", "content", "subject", "company", "company name", "value", "page_title", "event date", "product", "price", "message", "order_id")
# Notations of public template languages, mail merges and drafts.
_FORMS = (
    "{{ %s }}", "{{%s}}", "{{{%s}}}", "{{ page.%s }}", "{%% if %s %%}", "{%% block %s %%}", "{%% include '%s' %%}", "{%% endif %%}", "${%s}", "#{%s}", "{%s}", "<%%= %s %%>", "<%% %s %%>", "<?php echo $%s; ?>", "<?= $%s ?>", "[[%s]]", "[%%%s%%]", "*|%s|*", "%%%s%%", "%%%%%s%%%%", "##%s##", "__%s__", "$$%s$$", "$%s$", "@@%s@@", "@Model.%s", "@{%s}", "&lt;%s&gt;", "«%s»", "<<%s>>", "<%s>", "[%s]",
    "[Your %s]", "[your %s here]", "[Insert %s]", "[Insert %s here]", "[insert %s here]", "[INSERT %s HERE]", "[Enter %s]", "[Add %s]", "[add %s here]", "[%s here]", "[%s goes here]", "(%s goes here)", "(insert %s)", "<insert %s>", "<insert %s here>", "<your %s>", "<enter %s>", "<add %s here>", "[%s to be confirmed]", "[%s to be announced]", "[%s TBC]", "[%s TBD]", "Dear [%s],", "Dear <%s>,", "TODO: add %s", "TODO: %s", "TBD: %s", "FIXME: %s", "XXX: %s", "%s: TBD", "%s: [TBC]",
)
_PLAIN_FORMS = ("[object Object]", "[TBC]", "[TBD]", "[...]", "undefined undefined", "NaN undefined NaN", "Array ( [0] => )", "[citation needed]", "%s %d")


@dataclass(frozen=True)
class Settings:
    """rounds: in which the models learn from all records. pages: the text of more records weighs as that of so many against the seeds. line_ratio, error_ratio, stand_in_ratio: mean log-likelihood ratios per byte of a
    line of filler, error and stand-in text; the last may also show in a window alone. window_ratio: that of a placeholder in `window` bytes; shape_ratio: the same per symbol over `symbols` of them. seed_window, seed_ratio: windows that make a line residue to the next round; of
    error text only in records of at most `notice_bytes` and `notice_lines`. error_cover, residue_bytes, mark_bytes: coverage at which a record is
    excluded. ordinary: weight of ordinary uses of signs against notations. mention_reach, mention_window, mention_ratio: bytes on either side of a placeholder, and the window there whose mean ratio
    shows writing about placeholders."""

    pages: int = 2500
    rounds: int = 4
    line_ratio: float = 0.4
    error_ratio: float = 0.1
    stand_in_ratio: float = 0.3
    stand_in_window: int = 12
    stand_in_sure: float = 1.6
    window_ratio: float = 3.5
    window: int = 10
    shape_ratio: float = 2.5
    symbols: int = 2
    seed_window: int = 7
    seed_ratio: float = 3.5
    notice_bytes: int = 400
    notice_lines: int = 4
    error_cover: float = 0.6
    residue_bytes: int = 12
    mark_bytes: int = 5
    ordinary: int = 60
    mention_reach: int = 60
    mention_window: int = 8
    mention_ratio: float = 2.3


_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def grams(low: np.ndarray) -> np.ndarray:
    """Address of the n-gram that begins at each byte; digits count as one character."""
    x = low.copy()
    x[(x >= 48) & (x <= 57)] = 48
    x = x.astype(np.uint32) + np.uint32(1)
    n = len(x)
    h = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for k, m in enumerate(_MUL[:ORDER]):
            if k < n:
                h[: n - k] = (h[: n - k] ^ x[k:]) * m
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


# Classes of bytes: letters of any script and case, digits; all others stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 97, 48, 97


def shapes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Address of the n-gram of shape that begins at each symbol, and the symbol's place; runs of letters or digits are one symbol."""
    x = _SHAPE[buf]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | ((x[1:] != 97) & (x[1:] != 48))
    at = np.flatnonzero(new)
    return grams(x[at]), at


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram stands within the texts, by characters and by shape."""
    buf, starts = B.joined([t.lower().encode("utf-8", "replace") for t in texts])

    def count(g: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        ends = starts[1:] - 1 if at is None else np.searchsorted(at, starts[1:] - 1)
        across = np.unique(np.maximum(ends[:, None] - np.arange(ORDER), 0))
        return np.bincount(g, minlength=1 << BITS) - np.bincount(g[across], minlength=1 << BITS)

    return count(grams(buf), None), count(*shapes(buf))


def _count(texts: list[str], shape: bool = False) -> np.ndarray:
    return _counts(texts)[int(shape)].astype(float)


def _ratio(a: np.ndarray, b: np.ndarray, alpha: float = 0.3, usual: float = 0.0) -> np.ndarray:
    size = len(a)
    p = (a + alpha * (a.sum() / size + 1e-3)) / (a.sum() * (1 + alpha) + 1)
    q = (b + alpha * (b.sum() / size + 1e-3)) / (b.sum() * (1 + alpha) + 1)
    r = np.where((a == 0) & (b == 0), 0, np.clip(np.log(p / q), -4, 4))  # what nobody wrote is no evidence
    if usual:  # what other text says now and then is no evidence
        r = np.where(b > max(usual * b.sum(), 2), np.minimum(r, 0), r)
    return r.astype(np.float32)


def _noise(lines: int = 2000) -> list[str]:
    """Random signs and letters: junk that holds the signs of notations by chance."""
    g = np.random.default_rng(11)
    signs = list("!#$%&'()*+,-./:;<=>?@[]^_`{|}~ ")
    return ["".join(g.choice([*signs, "a", "b a"], 40)) for _ in range(lines)]


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by n-gram address: filler in made-up Latin, stand-in text, error notices, placeholders by characters and by shape, and mentions
    against other text."""

    filler: np.ndarray
    stand_in: np.ndarray
    error: np.ndarray
    mark: np.ndarray
    form: np.ndarray
    mention: np.ndarray
    settings: Settings


#: What a pass over records adds up: histograms by n-gram address and numbers, and under "known" a set of hashes.
Sums = dict[str, np.ndarray]


def _merged(a: Sums, b: Sums) -> Sums:
    return {k: a[k] if k not in b else b[k] if k not in a else np.union1d(a[k], b[k]) if k == "known" else a[k] + b[k] for k in {**a, **b}}


def _all_lines(texts: list[bytes]) -> Sums:
    chars, form = _counts([x for t in texts for x in t.decode("utf-8", "replace").split("\n") if x.strip()])
    return {"chars": chars, "shapes": form, "records": np.array([len(texts)])}


def _text(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [bytes(buf[a:b]) for a, b in zip(start.tolist(), end.tolist())]


def _hashes(lines: list[bytes]) -> np.ndarray:
    buf, starts = B.joined(lines)
    return B.span_hashes(buf, starts[:-1], starts[1:] - 1)


def _found_lines(m: "Model") -> Callable[[list[bytes]], Sums]:
    """N-grams of the lines that are residue to the next round, and hashes of these and of lines that hold a placeholder."""
    s = m.settings

    def run(texts: list[bytes]) -> Sums:
        f = scan(m, texts)
        n = len(f.marked)
        total = np.maximum(np.bincount(f.doc, weights=f.size, minlength=n), 1)
        brief = (total < s.notice_bytes) & (np.bincount(f.doc, minlength=n) <= s.notice_lines)
        filler, error = (_holds(x, f.grams, f, s.seed_window, s.seed_ratio) for x in (m.filler, m.error))
        filler |= f.filler_mean > s.line_ratio
        notice = (brief & (np.bincount(f.doc[error | f.error], minlength=n) > 0))[f.doc]
        marks = np.zeros(len(f.doc), bool)
        at = np.searchsorted(f.start, [a for a, _ in f.marks], side="right") - 1
        marks[at[at >= 0]] = True
        known = np.flatnonzero(filler | notice | marks)
        lines = _text(f.buf, f.start[known], f.end[known])
        kind = np.where(notice & ~filler, 1, np.where(filler, 0, -1))[known].tolist()
        count = lambda k: _counts([x.decode("utf-8", "replace") for x, j in zip(lines, kind) if j == k])[0]
        return {"filler": count(0), "error": count(1), "known": np.unique(_hashes(lines))}

    return run


def _known_lines(known: np.ndarray) -> Callable[[list[bytes]], Sums]:
    """N-grams of the lines whose hash is known, wherever they stand."""

    def run(texts: list[bytes]) -> Sums:
        if not len(known):
            return {}
        buf, starts = B.joined(texts)
        ln = B.lines_of(buf, starts)
        h = B.span_hashes(buf, ln.start, ln.end)
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        lines = [x.decode("utf-8", "replace") for x in _text(buf, ln.start[at], ln.end[at])]
        return dict(zip(("chars", "shapes"), _counts([x for x in lines if x.strip()])))

    return run


def _learn(over: Callable[[Callable[[list[bytes]], Sums]], Sums], s: Settings) -> Model:
    """Models of records; `over` adds up what a function says of their texts, part by part."""
    none = np.zeros(1 << BITS)
    marks = [*(f % w for f in _FORMS if f.count("%s") == 1 for w in (*_FIELDS, *(x.upper() for x in _FIELDS))), *_PLAIN_FORMS]
    shown = [f"word {x} word" for x in marks] + [f"word: {x}" for x in marks] + marks
    filler, error, stand_in, mark, form, mention = _count(list(FILLER_SEEDS)), _count(list(ERROR_SEEDS)), _count(list(STAND_IN_SEEDS)), _count(marks), _count(shown, True), _count(list(MENTION_SEEDS))
    plain, signs = _count(list(ORDINARY_SEEDS) * 5), _count(_noise() + list(ORDINARY_SEEDS) * s.ordinary, True)
    text, found, known = over(_all_lines), {}, {}
    share = min(1.0, s.pages / max(1, int(text.get("records", [0])[0])))
    for turn in range(s.rounds):
        o, shape = (share * (text.get(k, none) - known.get(k, none)) + x for k, x in (("chars", plain), ("shapes", signs)))
        more = lambda seeds, k: 3 * (seeds + share * found.get(k, none))
        m = Model(_ratio(more(filler, "filler"), o, usual=3e-6 * (turn > 0)), _ratio(3 * stand_in, o, usual=1e-5), _ratio(more(error, "error"), o, usual=3e-5 * (turn > 0)), _ratio(mark, o, usual=3e-6), _ratio(form, shape, usual=1e-4), _ratio(mention, o), s)
        if turn + 1 < s.rounds:  # what this round finds is residue to the next
            found = over(_found_lines(m))
            known = over(_known_lines(found.get("known", np.zeros(0, np.uint64))))
    return m


def train(texts: list[str], s: Settings = Settings()) -> Model:
    pages = [t.encode("utf-8", "replace") for t in texts]

    def over(f: Callable[[list[bytes]], Sums]) -> Sums:
        out: Sums = {}
        for lo in range(0, len(pages), 200):
            out = _merged(out, f(pages[lo : lo + 200]))
        return out

    return _learn(over, s)


def _holds(ratio: np.ndarray, g: np.ndarray, f: "Found", window: int, least: float) -> np.ndarray:
    """Lines that hold a window of the given mean ratio."""
    lo, _ = _windows(ratio, g, window, least)
    out = np.zeros(len(f.doc), bool)
    if len(lo):
        i = np.searchsorted(f.start, lo, side="right") - 1
        i = i[i >= 0]
        out[i] = True
    return out


def _mean(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0)
    stop = np.maximum(end - ORDER + 1, start + 1)
    return np.add.reduceat(values, np.stack([start, stop], 1).ravel(), dtype=float)[::2] / (stop - start)


@dataclass
class Found:
    """Per non-blank line: text, line number, bytes, and whether it is filler or an error notice; per text: bytes of placeholders,
    whose places are `marks`."""

    doc: np.ndarray
    no: np.ndarray
    size: np.ndarray
    filler: np.ndarray
    error: np.ndarray
    marked: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buf: np.ndarray
    marks: list[tuple[int, int]]
    filler_mean: np.ndarray
    grams: np.ndarray

    def verdict(self, s: Settings) -> np.ndarray:
        n = len(self.marked)
        total = np.bincount(self.doc, weights=self.size, minlength=n)
        e = np.bincount(self.doc, weights=self.size * (self.error | self.filler), minlength=n)
        f = np.bincount(self.doc, weights=self.size * self.filler, minlength=n)
        return (total > 0) & ((self.marked >= s.mark_bytes) | (e >= s.error_cover * total) & (e > 0) | (f >= s.residue_bytes))


def scan(m: Model, texts: list[bytes]) -> Found:
    s = m.settings
    buf, starts = B.joined(texts)
    ln = B.lines_of(buf, starts)
    black = (B.FLAGS[buf] & B.WS) == 0
    size = np.add.reduceat(black, ln.start, dtype=np.int64) if len(ln) else np.zeros(0, np.int64)  # a line break is blank
    keep = np.flatnonzero(size > 0)
    start, end, doc, no = ln.start[keep], ln.end[keep], ln.doc[keep], ln.no[keep]
    g = grams(B.lowered(buf)).astype(np.intp)
    filler, stand_in, error = (_mean(x[g], start, end) for x in (m.filler, m.stand_in, m.error))
    long = end - start >= ORDER + 3  # one odd n-gram is not enough
    marked = np.zeros(len(texts), np.int64)
    filled = long & ((filler > s.line_ratio) & (filler >= error) | (stand_in > s.stand_in_ratio) & (stand_in >= error))
    found = Found(doc, no, size[keep], filled, long & (error > s.error_ratio), marked, start, end, buf, [], filler, g)
    found.filler |= long & _holds(m.stand_in, g, found, s.stand_in_window, s.stand_in_sure)
    # placeholders: windows in which the model of their shapes, or that of their wording, is sure
    sg, at = shapes(buf)
    lo1, hi1 = _windows(m.form, sg, s.symbols, s.shape_ratio)
    lo2, hi2 = _windows(m.mark, g, s.window, s.window_ratio)
    reach = np.append(at, len(buf))
    lo, hi = np.concatenate([at[lo1], lo2]), np.concatenate([reach[np.minimum(hi1 + ORDER - 1, len(at))], hi2 + ORDER - 1])
    if len(lo):
        d = np.searchsorted(starts, lo, side="right") - 1
        hi = np.minimum(hi, starts[d + 1] - 1)  # an n-gram reaches over its end
        a, b = np.maximum(lo - s.mention_reach, starts[d]), np.minimum(hi + s.mention_reach, starts[d + 1] - 1)
        about = np.zeros(len(buf) + 1, np.int64)
        first, last = _windows(np.maximum(m.mention, 0), g, s.mention_window, s.mention_ratio)
        about[first + 1] = 1
        about = np.cumsum(about)
        true = about[np.maximum(lo - ORDER + 1, a)] - about[a] + about[np.maximum(b - ORDER + 1, hi)] - about[np.minimum(hi, b)] == 0
        np.add.at(marked, d[true], (hi - lo)[true])
        found.marks = list(zip(lo[true].tolist(), hi[true].tolist()))
    return found


def _windows(ratio: np.ndarray, g: np.ndarray, w: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches covered by windows of `w` n-grams whose mean ratio is over `least`."""
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.zeros(len(g) - w + 1, bool)  # a window over `least` holds a value over it
    over = np.flatnonzero((ratio > least)[g])
    for k in range(w):
        at = over - k
        near[at[(at >= 0) & (at < len(near))]] = True
    hot = np.flatnonzero(near)
    total = np.zeros(len(hot))
    for k in range(w):
        total += ratio[g[hot + k]]
    hot = hot[total / w > least]
    cuts = np.flatnonzero(np.diff(hot) > w) + 1
    return (hot[np.append(0, cuts)], hot[np.append(cuts - 1, len(hot) - 1)] + w) if len(hot) else (hot, hot)


_BLOCK = 1 << 14
_PARTS = "what string, block bigint, data binary"


def _part_sums(f: Callable[[list[bytes]], Sums]):
    """The sums over a partition, histograms in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Sums = {}
        for batch in batches:
            col = batch.column(0)
            for lo, hi in B.text_chunks(col):
                out = _merged(out, f([t.encode("utf-8", "replace") for t in col.slice(lo, hi - lo).to_pylist()]))
        known = out.pop("known", np.zeros(0, np.uint64))
        rows = [(k, lo // _BLOCK, part.tobytes()) for k, x in out.items() for lo in range(0, len(x), _BLOCK) if (part := x[lo : lo + _BLOCK]).any()]
        if len(known):
            rows.append(("known", 0, known.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["what", "block", "data"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[tuple[str, int], Sums] = {}
    for batch in batches:
        for what, block, data in zip(*(c.to_pylist() for c in batch.columns)):
            out[what, block] = _merged(out.get((what, block), {}), {what: np.frombuffer(data, np.uint64 if what == "known" else np.int64)})
    rows = [(*k, x[k[0]].tobytes()) for k, x in out.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["what", "block", "data"])


def fit(records: DataFrame, s: Settings = Settings(), rows: list | None = None) -> Model:
    """Models learnt from all records, or from `rows` alone where these are given."""
    if rows is not None:
        return train([r.content for r in rows], s)
    texts = records.where("content is not null").select("content")

    def over(f: Callable[[list[bytes]], Sums]) -> Sums:
        out: Sums = {}
        for r in texts.mapInArrow(_part_sums(f), _PARTS).repartition(16, "what", "block").mapInArrow(_add_up, _PARTS).collect():
            part = np.frombuffer(r.data, np.uint64 if r.what == "known" else np.int64)
            if r.what in ("known", "records"):
                out[r.what] = part
            else:
                out.setdefault(r.what, np.zeros(1 << BITS, np.int64))[r.block * _BLOCK : r.block * _BLOCK + len(part)] = part
        return out

    return _learn(over, s)


def _find(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            for lo, hi in B.text_chunks(col):
                texts = [t.encode("utf-8", "replace") for t in col.slice(lo, hi - lo).to_pylist()]
                out = np.flatnonzero(scan(m, texts).verdict(m.settings))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(out + lo))], ["id"])

    return run


def residue_records(records: DataFrame, s: Settings = Settings()) -> DataFrame:
    """id of the records to leave out."""
    rows = records.where("id is not null and content is not null")
    return rows.select("id", "content").mapInArrow(_find(fit(rows, s)), "id string").distinct()
