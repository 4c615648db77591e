"""Made-up labelled texts for the tagger: sentence frames of five languages with slots for values of every type.

A text is a few sentences. Frames say where a value stands, values are put together from parts in the forms people
write them, and sentences without any hold what looks alike: prices, dates, references, times, shops, streets without a
number, dishes. Case is changed now and then, as reviewers do. Everything follows from the random generator given.
"""

from __future__ import annotations

import random

GIVEN = {
    "en": "James Mary Jonathan Priya Thomas Olivia Daniel Grace Samuel Hannah Patrick Chloe George Amelia Kevin Zoe Rajesh Fatima Wei Aisha",
    "de": "Jürgen Anna Matthias Greta Stefan Ursula Lukas Heike Björn Katrin Uwe Sabine Emre Leyla Moritz Jana",
    "fr": "Jean Marie Pierre Camille Luc Élodie François Amélie Olivier Chloé Mehdi Inès Théo Manon Yves Noémie",
    "es": "José María Carlos Lucía Javier Carmen Andrés Sofía Álvaro Pilar Diego Elena Íñigo Rocío Manuel Inés",
    "pt": "João Ana Pedro Beatriz Thiago Mariana Rafael Larissa Luís Conceição Gustavo Júlia Caio Fernanda Otávio Lívia",
}
FAMILY = {
    "en": "Smith Whitmore Johnson O'Brien Carter Raghavan Sorensen Hughes Patel Bennett Walker Nguyen Clarke Foster Okafor Mitchell Khan Turner Reed McCarthy",
    "de": "Müller Schneider Weber Hoffmann Yilmaz Krüger Schröder Vogel Lehmann Böhm Winkler Brandt Seidel Arslan Groß Kaiser",
    "fr": "Martin Dubois Lefèvre Moreau Girard Benali Fontaine Chevalier Gauthier Perrin Marchand Renaud Lemaire Diallo Roux Blanc",
    "es": "García Fernández Muñoz Romero Ortega Castillo Iglesias Navarro Vega Ibáñez Herrera Núñez Campos Serrano Peña Molina",
    "pt": "Silva Oliveira Souza Ferreira Gonçalves Almeida Barbosa Ribeiro Araújo Cardoso Teixeira Moreira Nogueira Pinto Lopes Falcão",
}
SYLLABLES = "an bel cor dar el fen gar hol iv jor kal lin mor nor ost per quin ros sel tor ul ven wil yar zan bri cla dro fri gre stel trin pho sha kel mun dra sti ble wex".split()
ENDINGS = "son er ing worth ley ard elli ez ano eau ski moor ford by ton ini holt ova en".split()
TITLED = {"en": "Mr. |Mrs. |Ms |Dr. |", "de": "Herr |Frau |Dr. |", "fr": "M. |Mme |Mlle |", "es": "Sr. |Sra. |Don |", "pt": "Sr. |Sra. |Dona |"}

FRAMES = {
    "person": {
        "en": ["The cake was made by {}", "{} and her team looked after us all night", "We were greeted by {} at the door", "A big thank you to {} for the upgrade", "Please pass this on to {}", "My server {} was lovely", "I spoke with {} about the bill", "{}, the owner, came to our table", "The chef, {}, explained each dish", "Booked through {} as always", "It was {} who found my scarf", "Reported it to {} and nothing happened", "Best haircut ever, by {}", "— {}", "Regards,\n{}", "Ask to speak to {}", "{} was rude to my mother", "According to {}, the kitchen closes early", "A certain {} refused to help", "Both {} and I got ill afterwards", "Dentist {} was gentle", "Owner's name is {}", "Reviewed by {}", "Cheers {}!", "Signed: {}", "I went with {} and two friends", "They sacked {} last week", "Why did {} leave", "Compliments to {} in the kitchen", "My cousin {} from Dublin hated it", "{} plays the piano here on Fridays", "Nobody told {} about the change", "Credit where due: {} rocks", "We met {} by chance"],
        "de": ["Besonderer Dank gilt {}", "{} hat uns sehr nett beraten", "Der Kellner {} war unfreundlich", "Wir wurden von {} bedient", "Beschwerde ging an {}", "Laut {} war alles ausgebucht", "Gekocht hat {}", "Mit freundlichen Grüßen\n{}", "Liebe Grüße von {}", "Die Chefin, {}, kam an den Tisch", "Termin bei {} gehabt", "Ein gewisser {} legte einfach auf", "LG {}", "Am Empfang saß {}", "Meine Friseurin {} ist die beste", "Ich war mit {} aus Köln da", "Niemand hat {} informiert", "Am Klavier spielte {}", "Kompliment an {} in der Küche", "Schade, dass {} weg ist"],
        "fr": ["Un grand merci à {} pour son accueil", "Nous avons été servis par {}", "{} nous a très bien conseillés", "J'ai parlé avec {} de la note", "Le patron, {}, est venu à table", "Bien à vous,\n{}", "Le gâteau a été fait par {}", "Adressez-vous à {}", "Le docteur {} est patient", "Signé : {}", "Selon {}, c'était complet", "{} a été désagréable avec ma mère", "Rendez-vous pris avec {}", "Une certaine {} a raccroché", "Venu avec {} et des amis", "Personne n'a prévenu {}", "Au piano, {} chaque vendredi", "Chapeau à {} en cuisine", "Dommage que {} soit partie"],
        "es": ["Muchas gracias a {} por todo", "Nos atendieron {} y su equipo", "{} fue muy amable", "Hablé con {} sobre la cuenta", "El dueño, {}, vino a la mesa", "Atentamente,\n{}", "La tarta la hizo {}", "Según {}, estaba lleno", "Cita con {} a las diez", "Un tal {} me colgó", "Saludos de {}", "Firmado: {}", "El camarero {} era antipático", "Recomiendo a {} sin duda", "Fui con {} y unos amigos", "Nadie avisó a {}", "Al piano, {} cada viernes", "Felicidades a {} en la cocina", "El cuadro es obra de {}"],
        "pt": ["Muito obrigado a {} pela atenção", "Fomos servidos por {}", "{} foi muito simpática", "Falei com {} sobre a conta", "O dono, {}, veio à mesa", "Atenciosamente,\n{}", "O bolo foi feito por {}", "Segundo {}, estava cheio", "Consulta com {} na terça", "Um tal de {} desligou", "Beijos, {}", "Assinado: {}", "O garçom {} era grosso", "Recomendo {} de olhos fechados", "Fui com {} e uns amigos", "Ninguém avisou {}", "Ao piano, {} toda sexta", "Nota dez para {} na cozinha", "O quadro é obra de {}"],
    },
    "phone": {
        "en": ["Best to reserve on {}", "They never pick up {}", "My number: {}", "Phone {} if it turns up", "WhatsApp {}", "Reach me at {} after six", "The line {} was dead", "Text {} to book", "({})", "Mobile {}", "Contact: {}", "They gave me {} as the hotline", "I left {} for the callback"],
        "de": ["Reservieren unter {}", "Meine Nummer: {}", "Handy {}", "Am besten {} wählen", "Unter {} geht keiner ran", "Bitte melden: {}", "Rückruf an {}", "Tel.: {}"],
        "fr": ["Réservez au {}", "Mon numéro : {}", "Portable {}", "Le {} sonne dans le vide", "Contactez-moi au {}", "Tél. {}", "On m'a donné le {}"],
        "es": ["Reservas en el {}", "Mi número: {}", "WhatsApp {}", "Nadie contesta en {}", "Contacto: {}", "Tel. {}", "Me dieron el {}"],
        "pt": ["Reservas pelo {}", "Meu número: {}", "WhatsApp {}", "Ninguém atende no {}", "Contato: {}", "Tel. {}", "Me passaram o {}"],
    },
    "idnum": {
        "en": ["Tax file {}", "Passport {} was photocopied", "SSN: {}", "They typed my licence {} into the tablet", "ID {} on the form", "NI number {}", "Had to show document {}", "My national ID is {}", "Why do they need {} from my passport", "Membership needed my social security number {}"],
        "de": ["Steuernummer {}", "Pass {} wurde kopiert", "Ausweis-Nr. {}", "Meine Sozialversicherungsnummer {} stand auf dem Zettel", "Personalausweis {}", "Führerschein {} hinterlegt"],
        "fr": ["Passeport {}", "Numéro de sécu {}", "Ma pièce d'identité {} a été photocopiée", "Permis {}", "NIR {}", "Ils ont gardé mon numéro {}"],
        "es": ["DNI {}", "Pasaporte {} fotocopiado", "Mi NIE es {}", "Número de la seguridad social {}", "Apuntaron mi documento: {}", "Carné {}"],
        "pt": ["CPF {}", "RG {}", "Passaporte {} foi copiado", "Anotaram meu documento: {}", "CPF na nota: {}", "Minha identidade é {}"],
    },
    "street": {
        "en": ["The real entrance is {}", "They moved to {}", "My flat at {} is round the corner", "Sent to {} by mistake", "Address: {}", "Pick-up from {}", "We live on {}", "Turn left at {}", "Meet me outside {}", "Billing address {}", "Driver went to {} instead", "{} if you need parcels"],
        "de": ["Adresse: {}", "Sie sind in die {} gezogen", "Ich wohne {}", "Geliefert wurde an {}", "Eingang {}", "Treffpunkt {}", "Unser Büro, {}, liegt nebenan"],
        "fr": ["Adresse : {}", "Ils ont déménagé au {}", "J'habite {}", "Livré au {} par erreur", "Entrée par le {}", "Rendez-vous au {}", "Notre bureau, {}, est à côté"],
        "es": ["Dirección: {}", "Se mudaron a {}", "Mi casa, {}, está al lado", "Lo llevaron a {} por error", "Entrada por {}", "Quedamos en {}", "Enviar a {}"],
        "pt": ["Endereço: {}", "Mudaram para {}", "Minha casa, {}, fica ao lado", "Entregaram na {} por engano", "Entrada pela {}", "Encontro na {}", "Enviar para {}"],
    },
    "email": {
        "en": ["Write me at {}", "Email {}", "No reply from {}", "Invoice went to {}", "Contact {} for photos", "<{}>", "mail: {}"],
        "de": ["Mail an {}", "E-Mail: {}", "Keine Antwort von {}", "Rechnung bitte an {}"], "fr": ["Écrivez à {}", "Mail : {}", "Aucune réponse de {}"],
        "es": ["Escriban a {}", "Correo: {}", "Sin respuesta de {}"], "pt": ["Escrevam para {}", "E-mail: {}", "Sem resposta de {}"],
    },
}

PLAIN = {
    "en": ["The soup was cold and the bread stale", "Booking reference {n5} was lost", "Paid ${n2}.50 for two coffees", "Table {n2} by the window", "Order no. {n6} came late", "Open from {n1}:30 to 23:00", "We came on {n2}/0{n1}/202{n1}", "Room {n3} smelled of paint", "Blue Harbour Cafe is better", "Near Victoria Park and Harbour Street", "Happy New Year to the team at Golden Lion", "Voucher {n2}-{n2}-{n3} expired", "Try the Caesar Salad or the Black Forest Gateau", "Great Place, Great People", "Flight BA{n3} was on time", "I waited {n2} minutes", "Model X{n3} charger works", "Visited New York and San Francisco last year", "Complaint 202{n1}-{n4} is still open", "Wifi code {n4}", "Receipt {n6}, total {n2}.{n2}", "Invoice No {n4}/{n2}", "Saint Patrick Day was loud", "The staff is friendly and the chef is a genius", "Loved it"],
    "de": ["Die Suppe war kalt", "Buchung Nr. {n5} war weg", "Rechnung {n6} über {n2},50 Euro", "Tisch {n2} am Fenster", "Geöffnet ab {n1}:30 Uhr", "Am {n2}.0{n1}.202{n1} dort gewesen", "Zimmer {n3} roch nach Farbe", "Gasthaus Zum Goldenen Löwen ist besser", "Gleich an der Lindenallee", "Gutschein {n2}-{n3} abgelaufen", "Schnitzel Wiener Art mit Kartoffelsalat", "Frohe Weihnachten an das Team", "Leckere Currywurst und Kalte Getränke", "Die Bedienung war sehr nett"],
    "fr": ["La soupe était froide", "Réservation {n5} perdue", "Addition {n2},50 euros", "Table {n2} en terrasse", "Ouvert dès {n1}h30", "Venus le {n2}/0{n1}/202{n1}", "Chambre {n3} bruyante", "Le Petit Bistrot est mieux", "Près de la place de la République", "Bon d'achat {n2}-{n3} expiré", "Tarte Tatin et Crème Brûlée", "Joyeux Noël à l'équipe", "Le personnel est charmant"],
    "es": ["La sopa estaba fría", "Reserva {n5} perdida", "Pagamos {n2},50 euros", "Mesa {n2} junto a la ventana", "Abierto desde las {n1}:30", "Fuimos el {n2}/0{n1}/202{n1}", "Habitación {n3} ruidosa", "Casa Dorada es mejor", "Cerca de la Plaza Mayor", "Vale {n2}-{n3} caducado", "Tortilla Española y Patatas Bravas", "Feliz Navidad al equipo", "El personal es encantador"],
    "pt": ["A sopa estava fria", "Reserva {n5} perdida", "Pagamos {n2},50 reais", "Mesa {n2} na janela", "Aberto desde as {n1}h30", "Fomos em {n2}/0{n1}/202{n1}", "Quarto {n3} barulhento", "Casa Dourada é melhor", "Perto da Praça da Sé", "Vale {n2}-{n3} vencido", "Pão de Queijo e Feijoada Completa", "Feliz Natal para a equipe", "Os funcionários são ótimos"],
}


def _digits(rng: random.Random, shape: str) -> str:
    """A shape with digits for #, capital letters for @."""
    return "".join(rng.choice("0123456789") if c == "#" else rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "@" else c for c in shape)


def word(rng: random.Random) -> str:
    return ("".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2)))) + rng.choice(ENDINGS)).capitalize()


def person(rng: random.Random, lang: str) -> str:
    first = rng.choice(GIVEN[lang].split()) if rng.random() < 0.6 else word(rng)
    last = rng.choice(FAMILY[lang].split()) if rng.random() < 0.5 else word(rng)
    if rng.random() < 0.08:
        first += "-" + rng.choice(GIVEN[lang].split())
    if rng.random() < 0.08:
        last += "-" + word(rng)
    how = rng.random()
    if how < 0.1:
        return f"{last}, {first}"
    if how < 0.2:
        return f"{first} {rng.choice('ABCDEFGHJKLMRST')}. {last}"
    return f"{first} {last}"


def phone(rng: random.Random, lang: str) -> str:
    code, shapes = {
        "en": ("+1|+44", ["### ### ####", "###-###-####", "(###) ###-####", "###.###.####", "07### ######", "07#########", "020 #### ####", "1-800-###-####"]), "de": ("+49", ["030 #######", "0### #######", "01## ########", "0###/######", "0## ### ## ##"]),
        "fr": ("+33", ["0# ## ## ## ##", "06########", "0#.##.##.##.##", "0#-##-##-##-##"]), "es": ("+34", ["6## ### ###", "9## ## ## ##", "6########", "91# ### ###"]), "pt": ("+55", ["(##) #####-####", "## ####-####", "11 9####-####", "0## ## ## ## ##"]),
    }[lang]
    shape = rng.choice(shapes)
    if rng.random() < 0.35:
        lead = rng.choice(code.split("|"))
        shape = (lead if rng.random() < 0.7 else "00" + lead[1:]) + rng.choice((" ", "-", " ", "")) + shape.lstrip("0").removeprefix("1-")
    text = _digits(rng, shape)
    return text.translate(str.maketrans("0123456789+", "０１２３４５６７８９＋")) if rng.random() < 0.03 else text


def idnum(rng: random.Random, lang: str) -> str:
    shapes = {
        "en": ["###-##-####", "### ## ####", "@@ ## ## ## @", "@@######@", "@########", "#########", "@#######"], "de": ["@##@##@###", "## ###### @ ###", "@########", "## ### ### ###", "##/###/#####"],
        "fr": ["# ## ## ## ### ### ##", "#############", "##@@#####", "############"], "es": ["########@", "########-@", "@#######@", "@-#######-@", "##.###.###-@", "## ########## "], "pt": ["###.###.###-##", "##.###.###-#", "###########", "@@######", "### ### ### ##"],
    }[lang]
    return _digits(rng, rng.choice(shapes)).strip()


def street(rng: random.Random, lang: str) -> str:
    name = word(rng) if rng.random() < 0.6 else rng.choice(FAMILY[lang].split())
    number = str(rng.randrange(1, 400)) + (rng.choice("abcd") if rng.random() < 0.12 else "")
    if lang == "en":
        return f"{number} {rng.choice(('', '', '', 'North ', 'W ', 'Old '))}{name} {rng.choice(('Street', 'St', 'St.', 'Road', 'Rd', 'Lane', 'Ln', 'Avenue', 'Ave', 'Close', 'Drive', 'Court', 'Square', 'Terrace', 'Blvd', 'Gardens'))}"
    if lang == "de":
        return rng.choice((f"{name}{rng.choice(('straße', 'str.', 'weg', 'allee', 'platz', 'gasse', 'strasse'))} {number}", f"{name}er Straße {number}", f"Am {name} {number}"))
    if lang == "fr":
        return f"{number}{rng.choice((' ', ', '))}{rng.choice(('rue', 'avenue', 'av.', 'boulevard', 'bd', 'place', 'chemin', 'impasse'))} {rng.choice(('', '', 'de ', 'du ', 'des '))}{name}"
    kind = rng.choice(("Calle", "C/", "Avenida", "Av.", "Plaza", "Paseo", "Camino")) if lang == "es" else rng.choice(("Rua", "R.", "Avenida", "Av.", "Praça", "Travessa", "Alameda"))
    return f"{kind} {rng.choice(('', '', 'de ', 'das ' if lang == 'pt' else 'del '))}{name}{rng.choice((' ', ', ', ', nº ', ' n. '))}{number}"


def email(rng: random.Random, lang: str) -> str:
    first, last = (rng.choice(x[lang].split()) if rng.random() < 0.4 else word(rng) for x in (GIVEN, FAMILY))
    local = rng.choice(("{a}.{b}", "{a}{n}", "{a}_{b}", "{c}{b}", "{a}-{b}", "{b}.{a}{n}", "{a}+{t}", "info", "{a}")).format(a=first, b=last, c=first[0], n=rng.randrange(1, 2000), t=rng.choice(("food", "reviews", "list")))
    local = "".join(c for c in local.lower().replace("'", "") if c.isascii())
    host = rng.choice(("gmail", "outlook", "mail-box", "posthaus", word(rng).lower(), word(rng).lower()))
    end = rng.choice(("com", "de", "fr", "es", "com.br", "co.uk", "net", "example.org", "io"))
    at, dot = rng.choice((("@", "."),) * 8 + ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" @ ", "."), ("＠", ".")))
    return f"{local}{at}{host}{dot}{end.replace('.', dot)}"


MAKERS = {"person": person, "phone": phone, "idnum": idnum, "street": street, "email": email}


def plain(rng: random.Random, lang: str) -> str:
    text = rng.choice(PLAIN[lang])
    for n in "123456":
        while f"{{n{n}}}" in text:
            text = text.replace(f"{{n{n}}}", _digits(rng, rng.choice("123456789") + "#" * (int(n) - 1)), 1)
    return text


def with_value(rng: random.Random, kind: str, lang: str, frames: list[str] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with values of a type, and their spans."""
    frame = rng.choice(frames or FRAMES[kind][lang])
    before, after = frame.split("{}")
    title = rng.choice(TITLED[lang].split("|")) if kind == "person" and before and rng.random() < 0.2 else ""
    value = MAKERS[kind](rng, lang)
    how = rng.random()
    if kind in ("person", "street", "email") and how < 0.12:
        value = value.lower() if how < 0.08 or kind == "street" else value.upper()
    start = len(before) + len(title)
    text, spans = before + title + value, [(kind, start, start + len(value))]
    if kind == "person" and rng.random() < 0.12:
        more = person(rng, lang)
        text += {"en": " and ", "de": " und ", "fr": " et ", "es": " y ", "pt": " e "}[lang]
        spans.append((kind, len(text), len(text) + len(more)))
        text += more
    return text + after, spans


def made(rng: random.Random, frames: dict[str, dict[str, list[str]]] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of one to five sentences and its spans; ``frames`` replaces the frames of values."""
    lang = rng.choice(("en", "en", "de", "fr", "es", "pt"))
    text, spans = "", []
    for _ in range(rng.choice((1, 2, 2, 3, 4, 5))):
        if rng.random() < 0.6:
            kind = rng.choice(("person", "person", "phone", "idnum", "street", "email"))
            told = frames and frames.get(kind, {}).get(lang)
            piece, found = with_value(rng, kind, lang, told) if told or not frames else (plain(rng, lang), [])
        else:
            piece, found = plain(rng, lang), []
        spans += [(k, a + len(text), z + len(text)) for k, a, z in found]
        text += piece + rng.choice((". ", ". ", ". ", "! ", ".\n", " ", ", "))
    lower = text.lower()
    if rng.random() < 0.06 and len(lower) == len(text):
        text = lower
    elif rng.random() < 0.03 and len(text.upper()) == len(text):
        text = text.upper()
    return text.rstrip(), [s for s in spans if s[2] <= len(text.rstrip())]
