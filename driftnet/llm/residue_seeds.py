"""Seed texts of the residue classes. They are what the class models are fitted on, so they are data, not rules."""

from __future__ import annotations

#: Words of the customary dummy Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in "
    "reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in "
    "culpa qui officia deserunt mollit anim id est laborum vivamus suscipit tortor eget felis porttitor volutpat curabitur aliquet quam id "
    "dui posuere blandit donec sollicitudin molestie malesuada vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere "
    "cubilia curae mattis augue vitae porta nunc risus morbi tellus nibh ornare congue fusce justo lacus arcu urna erat quis "
    "pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas proin eget tortor risus"
).split()


def _latin(n: int = 120) -> list[str]:
    """Sentences of dummy words in many orders, so that the model knows the words and not one order."""
    out, at = [], 1
    for _ in range(n):
        words = []
        for _ in range(7):
            at = (at * 48271) % 2147483647
            words.append(LATIN[at % len(LATIN)])
        out.append(" ".join(words).capitalize() + ".")
    return out


FILLER_SEEDS = [
    *_latin(),
    *[
        "This is a sample paragraph. Replace it with your own words.", "Sample page", "This is an example page. Edit or delete it, then start writing!",
        "Your headline goes here", "Your text here. Click to edit.", "Add a short description of your business here.", "Tap to add title", "Tap to add text",
        "Click to add title", "Click to add text", "Second level", "Third level", "Fourth level", "TBD", "TBC", "TODO", "Placeholder text placeholder text placeholder text",
        "This is dummy text. Replace it with your own content.", "Insert your text here", "Text goes here", "Coming soon", "Sample text",
        "Dies ist ein Blindtext. Ersetzen Sie ihn durch Ihren eigenen Inhalt.", "Hier steht Ihre Überschrift", "Platzhalter Platzhalter Platzhalter",
        "Titel durch Klicken hinzufügen", "Text durch Klicken hinzufügen", "Beispielseite", "Hier steht Ihr Text. Zum Bearbeiten klicken.", "Zweite Ebene", "Dritte Ebene",
        "Dies ist eine Beispielseite. Bearbeiten oder löschen Sie sie und beginnen Sie zu schreiben.", "Fügen Sie hier eine kurze Beschreibung Ihres Unternehmens ein.",
        "Texte d'exemple à remplacer par votre contenu.", "Votre titre ici", "Votre texte ici", "Touchez pour ajouter un titre", "Touchez pour ajouter du texte",
        "Cliquez pour ajouter un titre", "Cliquez pour ajouter du texte", "Ceci est une page d'exemple. Modifiez-la ou supprimez-la.", "Deuxième niveau", "Troisième niveau",
        "Texto de ejemplo. Sustitúyalo por su propio contenido.", "Su título aquí", "Aquí va su título", "Aquí va su texto", "Su texto aquí", "Toque para agregar un título", "Toque para agregar texto",
        "Haga clic para agregar título", "Haga clic para agregar texto", "Esta es una página de ejemplo. Edítela o bórrela y empiece a escribir.", "Segundo nivel", "Tercer nivel",
        "Texto de relleno texto de relleno texto de relleno", "Escriba aquí su texto", "Añada aquí una breve descripción de su empresa.", "Título aquí",
    ]
    * 3,
]

ERROR_SEEDS = [
    "Gone (410)", "Not Found (404)", "Forbidden (403)", "410 Gone", "404 Not Found", "The page you asked for is not on this server.", "Error 404: not found", "Page not found", "The requested URL was not found on this server.",
    "We could not find what you were looking for. Go to home page", "Oops, something went wrong. Incident no. 12345", "Sorry, an error has occurred. Please try again later.",
    "403 Forbidden", "You may not view this here.", "Access denied. You lack the permission to open this folder.", "Access denied", "HTTP 403 Forbidden", "Ray 12ab34c",
    "400 Bad Request", "HTTP 400 Bad Request", "401 Unauthorized", "HTTP 408 Request Timeout", "HTTP 429 Too Many Requests", "Too many requests. Slow down.",
    "500 Internal Server Error", "HTTP 500 Internal Server Error", "Internal Server Error", "The server met an unexpected condition. Request id 12345",
    "HTTP Status 500 – Internal Server Error", "HTTP Status 404 – Not Found", "Type Status Report", "Message /index/12", "Description The server encountered an unexpected condition.",
    "502 Bad Gateway", "proxy at node12", "503 Service Unavailable", "504 Gateway Timeout", "Service temporarily unavailable", "We are down for maintenance until 12 o'clock.",
    "The service is down for maintenance. Please check back soon.", "Your session has expired. Please sign in again to go on.", "Error establishing a database connection",
    "Checking your browser before you go on. Enable cookies and scripts, then wait 5 seconds.", "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app.",
    "JavaScript is disabled in your browser. Please enable JavaScript to continue.", "This site requires JavaScript. Turn it on and reload the page.", "Please turn on cookies and JavaScript.", "This page cannot be shown", "Check the address or go back to the start page.",
    "Your browser has scripts turned off.", "This application needs scripts. Allow them in the browser and reload.", "Oops! Something went wrong.", "Our team has been told.",
    "Home | Login", "Menu | Login", "Home | Contact", "Menu | Contact", "Start | Login", "Menu | Help", "Home | Help", "abc-httpd/2.1", "httpd/1.12 Server", "nginx/1.18.0",
    "Warning: undefined variable $row in /srv/www/site/page.php on line 12", "Fatal error: call to a member function fetch() on null in /srv/www/site/db.php:12",
    "Traceback (most recent call last):", '  File "/opt/app/main.py", line 12, in render', "    return page[2]", "IndexError: list index out of range", "KeyError: 'name'",
    "TypeError: cannot read properties of undefined", "Exception in thread main java.lang.NullPointerException", "at com.example.Main.run(Main.java:12)", "ValueError: invalid literal",
    '{"error": {"code": 401, "message": "token expired"}}', '{"error": {"code": 500, "message": "internal error"}}', '{"status": 503, "detail": "quota used up", "data": null}',
    '{"status": 404, "detail": "not found", "data": null}', "segmentation fault (core dumped)", "Error code: 12345", "Request id 12345",
    "Fehler 404", "Die gewünschte Seite wurde nicht gefunden.", "Seite nicht gefunden", "Zugriff verweigert", "Sie haben keine Berechtigung für diese Seite.", "Interner Serverfehler.",
    "Bitte versuchen Sie es in 12 Minuten erneut.", "Wartungsarbeiten", "Der Dienst ist bis 12 Uhr nicht erreichbar.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich neu an.",
    "Ups, da ist etwas schiefgelaufen. Vorgang no. 12345", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Diese Seite benötigt JavaScript. Bitte aktivieren Sie es in Ihrem Browser.",
    "Diese Anwendung benötigt Skripte. Schalten Sie diese im Browser ein.", "In Ihrem Browser sind Skripte abgeschaltet.", "Diese Seite kann nicht angezeigt werden", "Ihr Browser wird geprüft. Bitte aktivieren Sie Cookies und Skripte.", "Anmelden | Kontakt", "Start | Hilfe", "Dienst vorübergehend nicht verfügbar",
    "Erreur 404", "La page demandée est introuvable.", "Page introuvable", "Accès refusé", "Vous n'avez pas l'autorisation d'ouvrir cette page.", "Erreur interne du serveur.",
    "Service momentanément indisponible, réessayez dans 12 minutes.", "Votre session a expiré. Reconnectez-vous.", "Oups, une erreur est survenue. Incident no. 12345", "Maintenance en cours",
    "Le service est indisponible jusqu'à 12 heures.", "Veuillez activer JavaScript pour afficher cette page.", "Ce site a besoin de JavaScript. Activez-le dans votre navigateur.",
    "Cette application a besoin de scripts. Autorisez-les puis rechargez.", "Les scripts sont désactivés dans votre navigateur.", "Vous n'avez pas le droit de voir cette page.", "Vérification de votre navigateur. Activez les cookies et les scripts.", "Accueil | Connexion", "Menu | Aide",
    "Error 404", "No se encontró la página solicitada.", "Página no encontrada", "Acceso denegado", "No tiene permiso para ver esta página.", "Error interno del servidor.",
    "Inténtelo de nuevo en 12 minutos.", "Servicio no disponible por el momento, vuelva a intentarlo en 12 minutos.", "Mantenimiento en curso", "El servicio no estará disponible hasta las 12.",
    "Su sesión ha caducado. Vuelva a iniciar sesión.", "¡Vaya! Algo salió mal. Incidencia no. 12345", "Active JavaScript para ver esta página.", "Necesita activar JavaScript para usar esta aplicación.",
    "Esta aplicación necesita scripts. Habilítelos en el navegador y recargue.", "Su navegador tiene los scripts desactivados.", "Comprobando su navegador. Active las cookies y los scripts.", "Inicio | Entrar", "Menú | Ayuda",
]

#: Sentences that speak of placeholders, filler, errors and scripts; placeholders in them are left out, as they are when contexts are scored.
SPEAKING_SEEDS = [
    "In the mail merge you type and the office program puts the real name there.", "In the template you write and the program fills in the customer.",
    "The backup script reads and stops when the disk is full.", "The script expands to the home folder.", "The old form asks for in brackets; ours was filled in by",
    "Minutes mark open points as until", "Open points are marked with in the minutes.", "Minutes mark open points as until 12 June 2009.",
    "Minutes mark open points as until 3 March 2021.", "Minutes mark open points as until 28 December 2015.", "Minutes mark open points as until 7 August 2018.", "By we mean that the ratio has no value at", "In the formula the set has members.",
    "The quotient is where the divisor is zero.", "The variable holds the value of the field.", "Write in place of the name.", "The placeholder stands for the customer name.",
    "Im Serienbrief steht , und das Programm setzt den Namen ein.", "In der Vorlage steht , das Programm ersetzt es durch den Namen.", "Das Skript liest und hält an, wenn die Platte voll ist.",
    "Im Formular steht in Klammern; bei uns hat es ausgefüllt.", "Offene Punkte sind im Protokoll mit markiert.", "Als Platzhalter dient in der Vorlage.", "In der Formel hat die Menge Elemente.",
    "Dans le modèle on écrit et le logiciel met le nom.", "Le script lit et s'arrête quand le disque est plein.", "L'ancien formulaire demande entre crochets ; le nôtre a été rempli par",
    "Le compte rendu note pour les points ouverts.", "Dans la formule, l'ensemble a éléments.", "On remplace par le nom du client.",
    "En la plantilla se escribe y el programa pone el nombre.", "El script lee y se detiene cuando el disco está lleno.", "El formulario antiguo pide entre corchetes; el nuestro lo rellenó",
    "El acta marca como los puntos abiertos.", "En la fórmula el conjunto tiene elementos.", "Se sustituye por el nombre del cliente.",
    "The site of our club said 404 Not Found all week, so I rang instead.", "The note said access denied, which made us laugh.", "told us to enable JavaScript in the settings before the video lesson starts.",
    "Printers set dummy text such as lorem ipsum to judge a typeface, explained.", "Die Seite von meldete tagelang Fehler 404, darum rief ich an.", "riet uns, JavaScript im Browser einzuschalten.",
    "Als Blindtext nimmt die Druckerei gern lorem ipsum.", "Le site de affichait erreur 404, alors j'ai appelé", "nous a dit d'activer JavaScript avant le cours.",
    "La página de dio error 404 toda la semana, así que llamé a", "nos dijo que activáramos JavaScript antes de la clase.", "Les imprimeurs composent du faux texte comme lorem ipsum.",
    "Los impresores usan texto falso como lorem ipsum.",
]

#: How templates write a field, ``x`` standing for its name, and what programs leave where a value was missing.
FIELD_FORMS = (
    "{{x}}", "{{ x }}", "${x}", "[[x]]", "<%= x %>", "<% x %>", "{% x %}", "<<x>>", "@@x@@", "%x%", "__X__", "«X»", "*|X|*", "%(x)s", "#X#", "{x}",
    "[Your x]", "[X here]", "[Insert x]", "<your x>", "<x here>", "<insert x>", "[Ihre x]", "[X hier]", "[Votre x]", "[X ici]", "[Insérer x]", "<votre x>", "<insérer x>", "[Su x]", "[X aquí]", "[Inserte x]", "<su x>",
)
MISSING_VALUES = ("{0}", "{1}", "{12}", "[object Object]", "undefined", "UNDEFINED", "Undefined", "null", "NaN", "XXXX", "XXXXX", "XXXXXX", "TBD", "TODO", "____", "______", "__________")
FIELD_NAMES = (
    "name", "first_name", "customer", "company", "city", "date", "amount", "order_no", "address", "signature", "vorname", "kunde", "firma", "ort", "datum", "betrag", "auftragsnr", "adresse", "unterschrift",
    "nom", "prénom", "client", "société", "ville", "montant", "commande", "adresse", "nombre", "cliente", "empresa", "ciudad", "fecha", "importe", "pedido", "dirección", "user.name", "invoice_id", "street name",
)


def _fields() -> list[str]:
    made = {f.replace("x", n) if "x" in f else f.replace("X", n.upper() if f[:1] in "_*#" else n.capitalize()) for f in FIELD_FORMS for n in FIELD_NAMES}
    return [f" {f} " for f in sorted(made)]


#: Placeholders in running text.
FIELD_SEEDS = _fields()
MISSING_SEEDS = [f" {x}{end}" for x in MISSING_VALUES for end in (" ", ".", ",", "\n")]
