"""Detection patterns and word lists.

Everything below is fixed values: the results depend on each of them being exactly so.  Patterns are in the
ECMAScript dialect and in detection order.
"""

from __future__ import annotations

from dataclasses import dataclass

# Categories with label, colour, priority and whether they are structured
CATEGORIES = [
    ("PERSONNE", "Personne physique", "#ffb3b3", 3, False),
    ("PERSONNE_MORALE", "Personne morale", "#ff9999", 7, False),
    ("AVOCAT", "Avocat", "#d4a3d4", 9, False),
    ("MAGISTRAT", "Magistrat/Greffier", "#c4a3e0", 9, False),
    ("JURIDICTION", "Juridiction", "#a3c4e0", 8, False),
    ("NUM_DOSSIER", "N° dossier/RG", "#b3cce6", 7, True),
    ("EMAIL", "Email", "#b3d9ff", 5, True),
    ("TEL", "Telephone", "#c2f0c2", 5, True),
    ("ADRESSE", "Adresse", "#ffd9b3", 4, False),
    ("NIR", "N° secu", "#e0b3ff", 6, True),
    ("IBAN", "IBAN", "#ffe0b3", 6, True),
    ("SIREN", "SIREN/SIRET", "#b3fff0", 6, True),
    ("DATE", "Date", "#fff0b3", 2, True),
    ("DATE_NAISSANCE", "Date de naissance", "#ffe680", 10, True),
    ("PLAQUE", "Plaque immat.", "#d9d9d9", 6, True),
    ("LIEU", "Lieu", "#c2e0c2", 4, False),
]
#: Found, but not replaced unless asked for.
PROFESSIONALS = ("AVOCAT", "MAGISTRAT")
PRIORITY = {name: p for name, _, _, p, _ in CATEGORIES}
STRUCTURED = tuple(name for name, _, _, _, s in CATEGORIES if s)

# Parts of patterns
MONTHS = "janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre"
UP, LOW, ANY = "A-ZÀ-ÖØ-ÞŸ", "a-zà-ÿ", "A-Za-zÀ-ÿ"
STREETS = (
    r"rue|avenue|av\.|boulevard|bd\.|bd|place|pl\.|impasse|imp\.|all[ée]e|chemin|route|quai|cours|passage|voie|r[ée]sidence|lot|lotissement|hameau|lieudit|lieu-dit|square|parvis|"
    r"esplanade|promenade|sentier|traverse|mont[ée]e"
)
COURTS = (
    "Cour de cassation", "Cour d'appel", "cour d'appel", "Cour d'assises", "Tribunal judiciaire", "tribunal judiciaire", "Tribunal de commerce", "tribunal de commerce",
    "Tribunal administratif", "tribunal administratif", "Tribunal correctionnel", "tribunal correctionnel", "Tribunal de police", "Tribunal des affaires de s[ée]curit[ée] sociale",
    "Tribunal paritaire des baux ruraux", "Tribunal de proximit[ée]", "Conseil de prud'hommes", "conseil de prud'hommes", "Conseil d'[EÉeé]tat", "Conseil constitutionnel",
    "Juge de l'ex[ée]cution", "Juge aux affaires familiales", "Juge des enfants", "Juge d'instruction", "Juge de la mise en [ée]tat", "Juge des libert[ée]s et de la d[ée]tention",
    "Juge des contentieux de la protection", "Juge commissaire", "Cour administrative d'appel", "Chambre de l'instruction", "Chambre des appels correctionnels",
)
LEGAL_FORMS = ("SAS", "SASU", "SARL", "EURL", "SA", "SCI", "SCP", "SCM", "SNC", "GIE", "SELARL", "SELAS", "SEL", "SELAFA", "SELCA", "GAEC", "EARL", "SCA", "SCIC", "SCOP")
FORMS = "|".join(LEGAL_FORMS)
COMPANY = rf"[{UP}][{ANY}&'-]{{1,40}}(?:[ '-][{UP}][{ANY}&'-]{{0,40}}){{0,3}}"
TITLES = r"Monsieur|Madame|Mme|Mlle|M\.|Me|Ma[iî]tre|Dr|Docteur|Pr|Professeur"
ROLES = (
    r"(?:le|la|les)\s+(?:requ[ée]rant(?:e)?|d[ée]fendeur(?:esse)?|demandeur(?:esse)?|appelant(?:e)?|intim[ée](?:e)?|pr[ée]venu(?:e)?|accus[ée](?:e)?|partie\s+civile|partie\s+intervenante|"
    r"assignant(?:e)?|assign[ée](?:e)?)"
)
RELATIONS = r"(?:consorts|[ée]poux|[ée]pouse|veuve|h[ée]ritiers\s+de|aux\s+droits\s+de|repr[ée]sent[ée](?:e)?\s+par|assist[ée](?:e)?\s+de)"
BY_LAWYER = r"(?:repr[ée]sent[ée]e?\s+par\s+(?:Me|Ma[iî]tre))"
NAME = rf"(?:[{UP}][{LOW}'-]+(?:\s+|-))*[{UP}][{UP}'-]{{1,}}|(?:[{UP}][{LOW}'-]+(?:\s+)){{1,3}}[{UP}][{LOW}'-]+"
SPOKEN = rf"((?:[{UP}][{LOW}'-]+\s+)*[{UP}][{ANY}'-]+)"
TOWN = rf"((?:[{UP}][{ANY}\-' ]+)(?:\s+\(\d{{2,5}}\))?)"
OFFICES = (
    r"Pr[ée]sident(?:e)?|Conseiller(?:[eè]re)?|Juge|Vice-[Pp]r[ée]sident(?:e)?|Procureur(?:e)?|Substitut|Greffier(?:[eè]re)?|Premier(?:e)?\s+Pr[ée]sident(?:e)?"
)


@dataclass(frozen=True)
class Pattern:
    """One detector: `group` is what becomes the span; loops over groups need the Python engine."""

    name: str
    category: str
    source: str
    ignore_case: bool = False
    group: int = 0
    check: str = ""  # "nir", "iban", "siren", "name" (length and stopwords), "place" (length), "caps"
    least: int = 0
    trimmed: bool = False
    engine: str = "catalyst"


# The patterns, in detection order
PATTERNS = [
    Pattern("email", "EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    Pattern("phone", "TEL", r"(?:(?:\+33|0033)\s?[1-9]|0[1-9])(?:[\s.-]?\d{2}){4}"),
    Pattern("nir", "NIR", r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", check="nir"),
    Pattern("iban", "IBAN", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){10,30}\b", check="iban"),
    Pattern("siren", "SIREN", r"(?<!\d[-\/.])\b\d{3}\s?\d{3}\s?\d{3}(?:\s?\d{5})?\b(?![-\/.]?\d)", check="siren"),
    Pattern("plate_new", "PLAQUE", r"\b[A-Z]{2}[-\s]?\d{3}[-\s]?[A-Z]{2}\b"),
    Pattern("plate_old", "PLAQUE", r"\b\d{1,4}[-\s]?[A-Z]{2,3}[-\s]?\d{2}\b"),
    Pattern("docket_rg", "NUM_DOSSIER", r"\bRG\s*(?:n°?\s*)?\d{2}[/-]\d{3,6}\b", True),
    Pattern("docket_no", "NUM_DOSSIER", r"\bn°?\s?\d{2}[/-]\d{3,6}\b"),
    Pattern("docket_minute", "NUM_DOSSIER", r"\b(?:MINUTE|PARQUET)\s*(?:n°?\s*)?\d{2}[/-]\d{3,8}\b", True),
    Pattern("birth_digits", "DATE_NAISSANCE", r"(?:n[ée]{1,2}\s+le\s+)(\d{1,2}[\/\s.-]\d{1,2}[\/\s.-]\d{2,4})", True, 1),
    Pattern("birth_month", "DATE_NAISSANCE", rf"(?:n[ée]{{1,2}}\s+le\s+)(\d{{1,2}}\s+(?:{MONTHS})\s+\d{{2,4}})", True, 1),
    Pattern("date_digits", "DATE", r"\b\d{1,2}[\/.-]\d{1,2}[\/.-]\d{2,4}\b"),
    Pattern("date_month", "DATE", rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{2,4}}\b", True),
    Pattern("street", "ADRESSE", rf"\b\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:{STREETS})\s+[^,\n]{{3,60}}?(?=[,\n]|$)", True),
    Pattern("postcode", "ADRESSE", rf"\b\d{{5}}\s+[{UP}][{ANY}'\- ]{{2,40}}"),
    Pattern("court", "JURIDICTION", rf"(?:{'|'.join(COURTS)})(?:\s+(?:de|d'|du|des)\s+[{UP}][{ANY}']+(?:-[{ANY}']+){{0,4}})?"),
    Pattern("company_form_first", "PERSONNE_MORALE", rf"\b(?:{FORMS})\s+({COMPANY})", False, 1, "name", 2, True),
    Pattern("company_form_last", "PERSONNE_MORALE", rf"\b({COMPANY})\s+(?:{FORMS})\b", False, 1, "name", 2, True),
    Pattern("company_named", "PERSONNE_MORALE", rf"(?:[Ll]a\s+)?(?:[Ss]oci[ée]t[ée]|[Ll]'(?:entreprise|association|fondation|mutuelle|caisse|banque|compagnie))\s+({COMPANY})", False, 1, "name", 2, True),
    Pattern("company_office", "PERSONNE_MORALE", rf"(?:Cabinet|[EÉ]tude|Office)\s+({COMPANY})", False, 1, "name", 2, True),
    Pattern("lawyer_title", "AVOCAT", rf"(?:Ma[iî]tre|Me)\s+{SPOKEN}", False, 1, "name", 2, engine="python"),
    Pattern("lawyer_word", "AVOCAT", rf"(?:avocat|avocate|conseil)\s*:?\s*{SPOKEN}", True, 1, "name", 2, engine="python"),
    Pattern("lawyer_for", "AVOCAT", rf"(?:repr[ée]sent[ée]e?\s+par\s+)(?:Me|Ma[iî]tre)\s+{SPOKEN}", True, 1, "name", 2, engine="python"),
    Pattern("lawyer_bar", "AVOCAT", r"(?:inscrite?\s+au\s+)?[Bb]arreau\s+d[e']\s*([A-ZÀ-ÿ][A-Za-zÀ-ÿ\-' ]{1,30})", False, 1, "name", 2, engine="python"),
    Pattern("judge_office", "MAGISTRAT", rf"(?:{OFFICES})\s*:?\s*{SPOKEN}", False, 1, "name", 2, engine="python"),
    Pattern("judge_bench", "MAGISTRAT", rf"(?:compos[ée]e?\s+de\s+)(?:(?:Mmes?|Mrs?|MM\.)\s+)?{SPOKEN}", False, 1, "name", 2, engine="python"),
    Pattern("person_title", "PERSONNE", rf"(?:(?:{TITLES}))\s+({NAME})", False, 1, "name", 2, engine="python"),
    Pattern("person_role", "PERSONNE", rf"(?:{ROLES})\s+({NAME})", False, 1, "name", 2, engine="python"),
    Pattern("person_relation", "PERSONNE", rf"(?:{RELATIONS})\s+({NAME})", False, 1, "name", 2, engine="python"),
    Pattern("person_by_lawyer", "PERSONNE", rf"(?:{BY_LAWYER})\s+({NAME})", False, 1, "name", 2, engine="python"),
    Pattern("person_between", "PERSONNE", rf"\b(?:ENTRE|Entre)\s*:?\s*\n?\s*((?:[{UP}][{LOW}'-]+\s+)*[{UP}][{UP}'-]+)", False, 1, "name", 3, engine="python"),
    Pattern("person_caps", "PERSONNE", rf"\b([{UP}][{LOW}'-]{{1,}}(?:\s+[{UP}][{LOW}'-]+)?\s+[{UP}]{{2,}}(?:[-\s][{UP}]{{2,}})*)\b", False, 1, "caps", 4, engine="python"),
    Pattern("place_birth", "LIEU", rf"(?:n[ée]{{1,2}}\s+[àa]\s+){TOWN}", True, 1, "place", 2, True),
    Pattern("place_home", "LIEU", rf"(?:demeurant\s+[àa]\s+|domicili[ée]e?\s+[àa]\s+|r[ée]sidant\s+[àa]\s+){TOWN}", True, 1, "place", 2, True),
    Pattern("place_nation", "LIEU", rf"(?:de\s+nationalit[ée]\s+)([{ANY}]+)", True, 1, "place", 2, True),
]
NUMBER = {p.name: i for i, p in enumerate(PATTERNS)}
BY_NAME = {p.name: p for p in PATTERNS}

# Words that are no names
STOPWORDS = (
    "ENTRE", "ET", "CONTRE", "SUR", "PAR", "POUR", "DANS", "AVEC", "ATTENDU", "QUE", "VU", "CONSIDERANT", "ORDONNE", "CONDAMNE", "DEBOUTE", "DIT", "JUGE", "DECLARE", "STATUANT",
    "REJETTE", "CONFIRME", "INFIRME", "ANNULE", "CASSE", "RENVOIE", "TRIBUNAL", "COUR", "CHAMBRE", "AUDIENCE", "ARRET", "JUGEMENT", "DECISION", "ORDONNANCE", "CONCLUSIONS", "BORDEREAU",
    "REPUBLIQUE", "FRANCAISE", "FRANCAIS", "ARTICLE", "CODE", "CIVIL", "PENAL", "PROCEDURE", "TRAVAIL", "COMMERCE", "PREMIER", "DEUXIEME", "TROISIEME", "TITRE", "CHAPITRE", "SECTION",
    "ALINEA", "PARAGRAPHE", *LEGAL_FORMS,
)

# Capitalised words that are no first names
NO_FIRST_NAMES = (
    "Code", "Article", "Loi", "Decret", "Arrete", "Ordonnance", "Jugement", "Arret", "Decision", "Audience", "Tribunal", "Cour", "Chambre", "Section", "Titre", "Chapitre", "Livre",
    "Partie", "Annexe", "Alinea", "Paragraphe", "Monsieur", "Madame", "Maitre", "Docteur", "Professeur", "Vu", "Attendu", "Considerant", "Statuant", "Ordonne", "Condamne", "Rejette",
    "Republique", "Francaise", "Etat", "Ministre", "Prefet", "Maire", "Janvier", "Fevrier", "Mars", "Avril", "Mai", "Juin", "Juillet", "Aout", "Septembre", "Octobre", "Novembre",
    "Decembre", "Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche", "Paris", "Lyon", "Marseille", "Bordeaux", "Lille", "Nice", "Toulouse", "Nantes", "Strasbourg",
    "Rennes", "Montpellier",
)

# Particles cut off the ends of names
PARTICLES = (
    "le", "la", "les", "l", "un", "une", "des", "de", "du", "d", "a", "au", "aux", "en", "par", "pour", "sur", "sous", "dans", "avec", "sans", "chez", "vers", "depuis", "entre", "et",
    "ou", "mais", "ni", "car", "or", "donc", "je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "me", "te", "se", "lui", "leur", "y", "ce", "cet", "cette", "ces", "mon",
    "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses", "notre", "votre", "nos", "vos", "leurs", "que", "qui", "quoi", "dont",
)

# What stands before a date, and runs of capitalised words
BIRTH_BEFORE = r"(?:n[ée]{1,2}\s+le|date\s+de\s+naissance|[âa]g[ée]{1,2}\s+de)\s*$"
DEATH_BEFORE = r"(?:d[ée]c[ée]d[ée]{1,2}\s+le|date\s+(?:du\s+)?d[ée]c[èe]s)\s*$"
PROCEDURE_BEFORE = (
    r"(?:audience\s+du|arr[eê]t\s+du|rendu\s+le|prononc[ée]\s+le|pourvoi\s+form[ée]\s+le|signifi[ée]\s+le|notifi[ée]\s+le|enregistr[ée]\s+le|d[ée]pos[ée]\s+le|re[çc]u\s+le|dat[ée]\s+du|"
    rf"en\s+date\s+du|du\s+(?:\d{{1,2}}\s+)?(?:{MONTHS}))\s*$"
)
NAME_RUN = rf"\b[{UP}][{LOW}'-]+(?:\s+[{UP}][{LOW}'-]+)*\b"
PAGE_HEADER = r"=== (.+?) — page (\d+)(?: \(OCR\))? ===\n\n"
HOCR_WORD = r"""(?is)<span[^>]*class=['"]ocrx_word['"][^>]*title=['"]bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)[^'"]*['"][^>]*>(.*?)</span>"""
