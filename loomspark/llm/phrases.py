"""Seed texts of the residue models: public standard messages, and phrases made from words by rule."""

from __future__ import annotations

import builtins
import errno
import os
import signal
from http import HTTPStatus
from itertools import product

# The customary filler passage, its source, and customary test strings.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore "
    "veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos "
    "curabitur pretium tincidunt lacus gravida orci odio vestibulum ante primis faucibus luctus ultrices posuere cubilia pellentesque habitant morbi tristique senectus netus malesuada fames turpis "
    "egestas praesent dapibus neque mauris vivamus phasellus suspendisse fermentum donec sagittis vehicula euismod porttitor aenean feugiat facilisis bibendum"
).split()
FILLER = [
    "lorem ipsum", "asdf asdf", "asdfgh jkl", "qwerty uiop", "qwertz", "azerty", "test test test", "foo bar baz", "xxx xxx xxx", "blah blah blah",
    "the quick brown fox jumps over the lazy dog", "dummy", "dummy text", "dummy content", "dummy entry", "placeholder", "placeholder text", "placeholder content",
    "placeholder paragraph", "sample text", "sample content", "example text", "filler text", "default text", "tbd", "to be determined", "to be completed later",
    "todo", "todo: write this", "fixme", "coming soon", "content goes here", "description goes here", "text goes here", "this is a test entry", "blindtext",
    "platzhalter", "platzhaltertext", "beispieltext", "mustertext", "fülltext", "hier steht der text", "hier kommt der inhalt hin", "noch auszufüllen",
    "texte de remplissage", "texte provisoire", "exemple de texte", "texte à compléter", "faux texte", "ici votre contenu", "à remplir", "texto de relleno", "texto de ejemplo",
    "texto provisional", "contenido de prueba", "aquí va el texto", "por completar", "testo di prova", "testo segnaposto", "testo di esempio", "texto de exemplo",
    "conteúdo de teste", "voorbeeldtekst", "tijdelijke tekst",
]
_MAKE = {
    "en": (("your", "the", "a"), ("text", "content", "review", "title", "headline", "comment", "message", "description", "name", "summary", "body"), ("{0} {1} here", "insert {0} {1} here", "enter {0} {1}", "type {0} {1} here", "please replace {0} {1}", "add {0} {1}", "write {0} {1}", "put {0} {1} here", "{1} goes here", "{0} {1} will appear here", "replace this {1}")),
    "de": (("ihr", "ihre", "den", "die"), ("text", "inhalt", "bewertung", "titel", "überschrift", "kommentar", "nachricht", "beschreibung", "name"), ("hier {0} {1}", "{0} {1} hier einfügen", "{0} {1} eingeben", "bitte {0} {1} ersetzen", "hier steht {0} {1}")),
    "fr": (("votre", "le", "la"), ("texte", "contenu", "avis", "titre", "commentaire", "message", "description", "nom"), ("{0} {1} ici", "insérez {0} {1}", "saisissez {0} {1}", "veuillez remplacer {0} {1}", "écrivez {0} {1} ici", "{1} à remplacer")),
    "es": (("su", "tu", "el", "la"), ("texto", "contenido", "reseña", "título", "comentario", "mensaje", "descripción", "nombre"), ("{0} {1} aquí", "inserte {0} {1}", "escriba aquí {0} {1}", "introduzca {0} {1}", "reemplace {0} {1}")),
    "it": (("il tuo", "la"), ("testo", "contenuto", "recensione", "titolo", "commento"), ("{0} {1} qui", "inserire {0} {1}", "scrivi {0} {1}")),
}

# What pages and servers say, as nouns and what happens to them.
_THINGS = {
    "en": (
        ("page", "content", "review", "reviews", "comments", "product", "item", "request", "server", "service", "resource", "file", "website", "site", "document", "data"),
        ("{} not found", "the {} you requested could not be found", "the {} you are looking for does not exist", "{} could not be loaded", "failed to load {}", "unable to load {}", "this {} is currently unavailable",
         "{} is temporarily unavailable", "{} no longer exists", "error loading {}", "an error occurred while loading the {}", "{} is not available in your region", "the {} has been removed", "{} failed", "you do not have permission to view this {}"),
    ),
    "de": (
        ("seite", "inhalt", "bewertung", "dienst", "server", "anfrage", "produkt", "datei"),
        ("{} nicht gefunden", "{} wurde nicht gefunden", "{} konnte nicht geladen werden", "{} ist derzeit nicht verfügbar", "{} ist vorübergehend nicht erreichbar", "fehler beim laden: {}", "{} existiert nicht", "keine berechtigung: {}", "{} ist fehlgeschlagen"),
    ),
    "fr": (
        ("page", "contenu", "avis", "service", "serveur", "requête", "produit", "fichier"),
        ("{} introuvable", "{} non trouvée", "{} est momentanément indisponible", "{} indisponible", "impossible de charger {}", "erreur lors du chargement: {}", "{} n'existe pas", "{} n'est plus disponible", "échec: {}"),
    ),
    "es": (
        ("página", "contenido", "reseña", "servicio", "servidor", "solicitud", "producto", "archivo"),
        ("{} no encontrada", "{} no encontrado", "{} no disponible", "{} no está disponible en este momento", "no se pudo cargar {}", "error al cargar {}", "{} no existe", "{} ya no está disponible", "fallo: {}"),
    ),
    "it": (("pagina", "contenuto", "servizio", "richiesta"), ("{} non trovata", "{} non disponibile", "impossibile caricare {}", "errore durante il caricamento: {}")),
    "pt": (("página", "conteúdo", "serviço"), ("{} não encontrada", "{} indisponível", "erro ao carregar {}")),
    "nl": (("pagina", "inhoud", "dienst"), ("{} niet gevonden", "{} is niet beschikbaar", "kan {} niet laden")),
}
_NOTICES = [
    "error", "error 0", "error code: 0", "0 error", "http error 0", "http status 0", "an error occurred", "an unexpected error has occurred", "something went wrong", "oops! something went wrong", "whoops, something went wrong on our end",
    "please try again", "please try again later", "try again in a few moments", "please reload the page", "refresh the page", "retry", "if the problem persists, contact the administrator", "go back to the home page",
    "your session has expired", "session expired, please log in again", "session timed out, sign in again", "you have been logged out", "please sign in to continue", "access denied", "access to this resource is forbidden", "permission denied",
    "too many requests, please slow down", "rate limit exceeded", "you have been temporarily blocked", "the request timed out", "connection timed out", "connection reset by peer", "connection refused", "network error", "dns lookup failed",
    "host not reachable", "the server encountered an internal error and was unable to complete your request", "the server is down for maintenance", "we are performing scheduled maintenance", "down for maintenance, back soon", "be right back",
    "bad gateway", "gateway timeout", "upstream server sent no response", "invalid response from upstream", "error establishing a database connection", "database error", "could not connect to database", "invalid request", "invalid token",
    "reference id: 0", "incident id 0", "request id: 0", "ray id: 0", "trace id: 0", "error reference 0", "ticket no. 0",
    "fehler", "fehlercode 0", "interner serverfehler", "interner fehler", "es ist ein fehler aufgetreten", "ein unerwarteter fehler ist aufgetreten", "etwas ist schiefgelaufen", "bitte versuchen sie es später erneut", "bitte später noch einmal versuchen",
    "zugriff verweigert", "ihre sitzung ist abgelaufen", "bitte melden sie sich erneut an", "wartungsarbeiten", "wegen wartungsarbeiten nicht erreichbar, wir sind bald zurück", "zeitüberschreitung der anforderung", "zu viele anfragen", "verbindung fehlgeschlagen", "vorgangsnummer 0",
    "erreur", "erreur 0", "erreur interne", "erreur interne du serveur", "une erreur est survenue", "une erreur inattendue s'est produite", "veuillez réessayer plus tard", "réessayez dans quelques instants", "accès refusé", "accès interdit", "votre session a expiré",
    "veuillez vous reconnecter", "site en cours de maintenance", "maintenance en cours, retour bientôt", "délai d'attente dépassé", "trop de requêtes", "connexion impossible", "référence 0", "code d'erreur 0",
    "error interno", "error interno del servidor", "se ha producido un error", "ha ocurrido un error inesperado", "algo salió mal", "inténtelo de nuevo más tarde", "vuelva a intentarlo", "acceso denegado", "acceso prohibido", "su sesión ha caducado", "la sesión ha expirado",
    "inicie sesión de nuevo", "sitio en mantenimiento", "en mantenimiento, volvemos pronto", "tiempo de espera agotado", "demasiadas solicitudes", "no se puede conectar", "referencia 0", "código de error 0", "errore interno del server", "si è verificato un errore", "riprova più tardi",
    "accesso negato", "sessione scaduta", "erro interno do servidor", "ocorreu um erro", "tente novamente mais tarde", "er is een fout opgetreden", "probeer het later opnieuw", "toegang geweigerd",
]
_DUMPS = [
    "traceback (most recent call last):", 'file "main.py", line 0, in <module>', 'file "/usr/lib/python0/site-packages/app/views.py", line 0, in get', "during handling of the above exception, another exception occurred:", "stack trace:", "stacktrace", "caused by:",
    'exception in thread "main" java.lang.illegalstateexception', "java.lang.nullpointerexception", "java.io.ioexception", "java.lang.illegalargumentexception: null", "at java.base/java.util.arraylist.get(arraylist.java:0)", "at org.example.app.service.handle(service.java:0)",
    "at com.example.web.controller.render(controller.java:0)", "... 0 more", "unhandled exception", "uncaught exception", "uncaught typeerror: cannot read property of undefined", "typeerror: undefined is not a function", "typeerror: cannot read properties of null (reading 'length')",
    "referenceerror: x is not defined", "syntaxerror: unexpected token < in json at position 0", "unexpected end of json input", "at object.<anonymous> (/app/index.js:0:0)", "at process.processticksandrejections (node:internal/process/task_queues:0:0)", "[object object]", "[object promise]",
    "undefined", "undefined undefined", "null", "null null", "nan", "nan nan", "none none", "fatal error: uncaught error: call to undefined function in /var/www/html/index.php:0", "warning: undefined variable $x in /var/www/html/page.php on line 0", "notice: undefined index: id in /home/site/public/view.php on line 0",
    "parse error: syntax error, unexpected end of file", "php fatal error: allowed memory size of 0 bytes exhausted", "you have an error in your sql syntax; check the manual that corresponds to your mysql server version", "sqlstate[0]: general error: 0", "ora-0: table or view does not exist",
    "error: relation does not exist at character 0", "deadlock found when trying to get lock", "panic: runtime error: index out of range [0] with length 0", "goroutine 0 [running]:", "panic: runtime error: invalid memory address or nil pointer dereference", "thread 'main' panicked at src/main.rs:0:0:",
    "note: run with `rust_backtrace=0` environment variable to display a backtrace", "system.nullreferenceexception: object reference not set to an instance of an object.", "at program.main(string[] args) in c:\\app\\program.cs:line 0", "segmentation fault (core dumped)", "core dumped", "out of memory",
    "kernel panic - not syncing", '{"error": "internal_error", "message": "request failed", "code": 0}', '{"status": "error", "code": 0, "detail": "not found"}', '{"errors": [{"code": 0, "message": "bad input"}], "data": null}', "<title>0 not found</title>", "<h0>internal server error</h0>",
    "<html><head><title>error 0</title></head><body>", "</body></html>", "<!doctype html>", "<?xml version=\"0.0\" encoding=\"utf-0\"?><error><code>", "nomethoderror: undefined method for nil:nilclass", "actionview::template::error", "django.core.exceptions.improperlyconfigured", "template error: undefined variable",
]

_SCRIPTS = {
    "en": (("javascript", "java script", "scripts", "scripting", "cookies", "javascript and cookies", "cookies and scripts"), ("please enable {}", "please enable {} to view this page", "please turn on {} and reload the page", "you need to enable {} to run this app", "{} is disabled in your browser", "{} must be enabled", "this site requires {}", "this website needs {} to work properly",
        "your browser does not support {}", "{} is required to view this content", "enable {} to continue", "switch on {} in your browser settings", "allow {} to see the comments", "{} appears to be disabled", "we have detected that {} is turned off", "this page does not work without {}", "to continue, allow {}", "noscript: {} needed")),
    "de": (("javascript", "skripte", "cookies", "javascript und cookies"), ("bitte aktivieren sie {}", "bitte aktivieren sie {}, um fortzufahren", "{} ist in ihrem browser deaktiviert", "{} ist abgeschaltet", "diese seite benötigt {}", "ohne {} kann diese seite nicht angezeigt werden", "schalten sie {} in den einstellungen ein", "für diese seite muss {} eingeschaltet sein", "ihr browser unterstützt {} nicht")),
    "fr": (("javascript", "les scripts", "les cookies", "javascript et les cookies"), ("veuillez activer {}", "veuillez activer {} pour afficher cette page", "{} est désactivé dans votre navigateur", "{} sont désactivés", "ce site nécessite {}", "cette page a besoin de {} pour fonctionner", "activez {} pour continuer", "votre navigateur ne prend pas en charge {}")),
    "es": (("javascript", "los scripts", "las cookies", "javascript y cookies"), ("active {}", "active {} para ver esta página", "habilite {} en su navegador", "{} está desactivado en su navegador", "{} están desactivados", "este sitio necesita {}", "esta página requiere {} para funcionar", "su navegador no admite {}", "para continuar, active {}")),
    "it": (("javascript", "i cookie", "gli script"), ("abilita {} per continuare", "{} è disattivato nel browser", "questo sito richiede {}", "attivare {} per visualizzare la pagina", "è necessario attivare {}")),
    "pt": (("javascript", "cookies"), ("ative {} para continuar", "{} está desativado no seu navegador", "este site requer {}")),
    "nl": (("javascript", "cookies"), ("schakel {} in om door te gaan", "{} is uitgeschakeld in uw browser", "deze site vereist {}")),
}
_BROWSER = ["checking your browser before accessing the site", "checking if the site connection is secure", "this may take a few seconds", "verify you are human", "please wait while we verify your browser", "ddos protection by", "you are being redirected", "loading, please wait", "your browser is out of date", "<noscript>", "</noscript>"]

# People who talk about such texts.
MENTION = [
    "the screen displayed an error for a second and then it was fine", "i saw an error message once, after a restart it was gone", "the app told me there was an error so i called support", "it crashed with an error twice last week but works now",
    "their website wanted me to turn on javascript before i could order", "i had to switch on javascript in the shop to pay, annoying", "the poster on the wall says lorem ipsum, which made me laugh", "the sample print had lorem ipsum on it",
    "the program fills in my templates, a variable like {{total}} becomes a number", "i type placeholders such as ${date} in the editor and it replaces them", "the seller's page was not found at first, later i could order", "i got page not found when i tried the manual's link",
    "i work as a programmer and look at stack traces all day", "the manual has a chapter on what to do about error codes", "it kept asking for permission and then worked",
    "auf dem display stand kurz ein fehler, danach ging alles", "die webseite wollte, dass ich javascript einschalte", "das gerät zeigte eine fehlermeldung und lief dann wieder", "auf der verpackung stand blindtext, lustig",
    "l'écran a affiché une erreur puis tout a marché", "le site m'a demandé d'activer javascript pour commander", "l'application a montré un message d'erreur une fois", "la pantalla mostró un error y después todo bien",
    "la web me pidió activar javascript para comprar", "la aplicación dio un mensaje de error una vez", "i give it 0 out of 0", "i would rate it [0 out of 0]", "0 von 0 punkten", "0 sur 0 pour moi", "le doy 0 de 0",
]

# Names of the HTML standard's autofill fields and of schema.org's properties of persons, products, orders and reviews, without separators.
FIELD_NAMES = set(
    "name honorificprefix givenname additionalname familyname nickname username organization organizationtitle streetaddress addressline countryname country postalcode language bday url photo tel email "
    "firstname lastname fullname user nick product productname productid item itemname title brand model category color colour size material weight height width price currency sku gtin manufacturer description "
    "image logo review reviewer reviewbody reviewrating rating ratingvalue author headline text body content datepublished date time year customer customername buyer seller sender recipient order orderno orderid ordernumber orderdate "
    "orderstatus orderdelivery deliverydate shop store company city state region address telephone phone gender jobtitle website link subject message comment placeholder value".split()
)


def _combined(tables: dict) -> list[str]:
    out = []
    for table in tables.values():
        *words, frames = table
        out += [frame.format(*w) for frame in frames for w in product(*words)]
    return out


def seed_texts() -> dict[str, list[str]]:
    statuses = [f"{s.value} {s.phrase}" for s in HTTPStatus if s >= 400] + [s.phrase for s in HTTPStatus if s >= 400] + [s.description for s in HTTPStatus if s >= 400 and s.description]
    system = [os.strerror(n) for n in errno.errorcode] + [signal.strsignal(s) or "" for s in signal.Signals]
    raised = [f"{n}: " for n, e in vars(builtins).items() if isinstance(e, type) and issubclass(e, Exception)]
    return {
        "filler": FILLER + _combined(_MAKE),
        "latin": [f"{a} {b}" for a in LOREM for b in LOREM],
        "error": _NOTICES + _DUMPS + _combined(_THINGS) + statuses + system + raised,
        "script": _BROWSER + _combined(_SCRIPTS),
        "mention": MENTION,
    }
