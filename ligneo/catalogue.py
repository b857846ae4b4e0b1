"""Fixed values of the national file formats.

Everything in this module is a fixed value: names, widths, positions, patterns and word lists that
must be exactly these for a file to be read rightly. Ranges are 0-based and half-open.
"""

from collections import namedtuple

Format = namedtuple(
    "Format", "name length ipp_start ipp_end ddn_start ddn_end description family since identified"
)

# Record formats.
FORMATS = [
    Format("RPS", 154, 21, 41, 41, 49, "Résumé Par Séquence — Hospitalisation PSY", "PSY", 2007, True),
    Format("RAA", 96, 21, 41, 41, 49, "Recueil Activité Ambulatoire — PSY", "PSY", 2007, True),
    Format("RPSA", 157, 0, 0, 0, 0, "Résumé Par Séquence Anonyme — sortie PIVOINE, sans identifiant patient", "PSY", 2007, False),
    Format("R3A", 139, 0, 0, 0, 0, "Résumé Activité Ambulatoire Anonyme — sortie PIVOINE, sans identifiant patient", "PSY", 2009, False),
    Format("VID-IPP", 135, 80, 100, 15, 23, "VID-IPP — chaînage des patients vus en ambulatoire", "PSY", 2023, True),
    Format("HOSP-PMSI", 40, 0, 0, 0, 0, "HOSP-PMSI — lien numéro de séjour / numéro administratif, sans identifiant patient", "TRANSVERSAL", 2009, False),
    Format("HOSP-FACT", 29, 0, 0, 0, 0, "HOSP-FACT — lien séjour / numéro d'entrée, sans identifiant patient", "PSY", 2020, False),
    Format("FICHCOMP-ISO", 113, 0, 0, 0, 0, "FICHCOMP isolement et contention — rattaché au séjour, sans identifiant patient", "PSY", 2022, False),
    Format("FICHCOMP-TP", 47, 0, 0, 0, 0, "FICHCOMP temps partiel — rattaché au séjour, sans identifiant patient", "PSY", 2022, False),
    Format("FICHSUP-PSY", 83, 0, 0, 0, 0, "FichSup — recueil agrégé, supprimé en psychiatrie depuis le 01/01/2021", "PSY", 2012, False),
    Format("FICUM-PSY", 38, 0, 0, 0, 0, "Fichier des unités médicales — référentiel d'UM, sans donnée patient", "PSY", 2017, False),
    Format("RSF-ACE-PSY", 246, 210, 230, 0, 0, "RSF-A début de facture — PSY ex-OQN", "PSY", 2020, True),
    Format("RHS", 177, 0, 0, 68, 76, "Résumé Hebdomadaire Standardisé — SMR, sans identifiant patient", "SSR", 2003, False),
    Format("SSRHA", 53, 0, 0, 0, 0, "SMR anonymisé — transmission ARS, sans identifiant patient", "SSR", 2009, False),
    Format("RAPSS", 164, 0, 0, 0, 0, "RAPSS anonyme — sans identifiant patient", "SSR", 2009, False),
    Format("FICHCOMP-SMR", 63, 0, 0, 0, 0, "FichComp transports SMR — sans identifiant patient", "SSR", 2012, False),
    Format("RPSS", 190, 21, 41, 61, 69, "RPSS — Résumé Par Sous-Séquence HAD", "HAD", 2005, True),
    Format("RAPSS-HAD", 164, 0, 0, 0, 0, "RAPSS-HAD anonyme — sans identifiant patient", "HAD", 2009, False),
    Format("FICHCOMP-HAD", 105, 0, 0, 0, 0, "FichComp HAD — sans identifiant patient", "HAD", 2010, False),
    Format("SSRHA-HAD", 120, 0, 0, 0, 0, "Anonymisé HAD post-groupage — sans identifiant patient", "HAD", 2012, False),
    Format("VID-HOSP", 520, 353, 373, 19, 27, "Vidhosp — entrée du chaînage anonyme, traitée par MAGIC", "TRANSVERSAL", 2009, True),
    Format("ANO-HOSP", 1064, 0, 0, 0, 0, "ANO — sortie de MAGIC, le NIR y est remplacé par la clé de chaînage", "TRANSVERSAL", 2009, False),
    Format("FICHCOMP", 63, 0, 0, 0, 0, "FichComp transports — rattaché au séjour, sans identifiant patient", "TRANSVERSAL", 2010, False),
    Format("RSS", 198, 0, 0, 62, 70, "RSS/RUM — MCO, sans identifiant patient", "MCO", 1991, False),
    Format("RSFA", 257, 221, 241, 0, 0, "RSF-A début de facture — MCO", "MCO", 2009, True),
    Format("RSFB", 182, 0, 0, 0, 0, "RSF-B prestations hospitalières — MCO, sans identifiant patient", "MCO", 2009, False),
    Format("RSFC", 167, 0, 0, 0, 0, "RSF-C honoraires — MCO, sans identifiant patient", "MCO", 2009, False),
]
FORMAT = {f.name: f for f in FORMATS}
UNKNOWN = "INCONNU"

# Older line lengths still accepted, with the positions of the current format.
LENGTH_VARIANTS = [("RPS", 142), ("RPS", 148), ("RAA", 86), ("RAA", 90)]

# File-name patterns on the lower-cased base name; the first match decides.
NAME_PATTERNS = [
    (r"hosp[\-_.]?pmsi", "HOSP-PMSI"),
    (r"hosp[\-_.]?fact", "HOSP-FACT"),
    (r"vid[\-_.]?ipp|(^|[\-_ ])vipp|(^|[\-_ ])ipp_\d", "VID-IPP"),
    (r"(^|[\-_ ])vh[\-_.]", "VID-HOSP"),
    (r"fc[\-_.]?ic|(^|[\-_ ])iso_\d|fichcomp[\-_ ]?iso", "FICHCOMP-ISO"),
    (r"fc[\-_.]?htp|(^|[\-_ ])tp_\d|fichcomp[\-_ ]?(temps|tp)", "FICHCOMP-TP"),
    (r"rpsa", "RPSA"),
    (r"r3a", "R3A"),
    (r"fichsup[\-_.]?psy|fichsup|fic[\-_]?sup", "FICHSUP-PSY"),
    (r"ficum[\-_.]?psy|ficum", "FICUM-PSY"),
    (r"rsf[\-_.]?ace[\-_.]?psy", "RSF-ACE-PSY"),
    (r"fichcomp[\-_.]?smr|fichcomp[\-_.]?ssr", "FICHCOMP-SMR"),
    (r"ssrha[\-_.]?had", "SSRHA-HAD"),
    (r"ssrha", "SSRHA"),
    (r"rapss[\-_.]?had", "RAPSS-HAD"),
    (r"rapss", "RAPSS"),
    (r"rhs", "RHS"),
    (r"fichcomp[\-_.]?had", "FICHCOMP-HAD"),
    (r"rpss", "RPSS"),
    (r"vid[\-_.]?hosp|vidhosp|\.vid", "VID-HOSP"),
    (r"ano[\-_.]?hosp|anohosp", "ANO-HOSP"),
    (r"rsf[\-_.]?c|rsfc", "RSFC"),
    (r"rsf[\-_.]?b|rsfb", "RSFB"),
    (r"rsf[\-_.]?a|rsfa|rsf[\-_.]?ace", "RSFA"),
    (r"fichcomp|fic[\-_]?comp|\.com", "FICHCOMP"),
    (r"rss|rum", "RSS"),
    (r"rps", "RPS"),
    (r"raa", "RAA"),
]

# Extensions that are never fixed-width files.
SKIPPED_EXTENSIONS = [
    "xls", "xlsx", "xlsm", "zip", "7z", "rar", "gz", "pdf", "json", "log", "docx", "doc", "odt", "html", "htm", "xml",
    "png", "jpg", "jpeg", "gif", "bmp", "exe", "dll", "msi", "lnk", "tmp", "bak",
]
# The shorter list used when pseudonymising.
SKIPPED_WHEN_PSEUDONYMISING = [
    "xls", "xlsx", "xlsm", "zip", "pdf", "json", "csv", "log", "docx", "doc", "html", "png", "jpg",
]

# Repeated zones (name, counter start 1-based, counter length, block length), in line order.
Zone = namedtuple("Zone", "name count_start count_length block_length")
FIXED_LENGTH = {"RPS": 154, "RAA": 96, "VID-HOSP": 470}
ZONES = {
    "RPS": [Zone("DA", 151, 2, 8), Zone("ZA", 153, 2, 23)],
    "RAA": [Zone("DA", 95, 2, 8)],
    "VID-HOSP": [Zone("DMT", 467, 4, 50)],
}
# Fields inside a block (offset 0-based, length, role); the VID-HOSP block comes from its layout.
BLOCK_FIELDS = {
    ("RPS", "DA"): [(0, 8, "Keep")],
    ("RPS", "ZA"): [(0, 8, "Date"), (8, 15, "Keep")],
    ("RAA", "DA"): [(0, 8, "Keep")],
}

# 0-based position of the 9-digit establishment number.
FINESS_OFFSET = {
    "RPS": 0, "RAA": 0, "RPSA": 0, "R3A": 0, "FICHCOMP": 0, "FICHCOMP-ISO": 0, "FICHCOMP-TP": 0,
    "RSF-ACE-PSY": 1, "VID-HOSP": 52, "VID-IPP": 52,
}
# Formats holding activity, and those holding patient linkage in order of preference.
ACTIVITY_FORMATS = ["RPS", "RAA", "RPSA", "R3A", "RHS", "SSRHA", "RAPSS", "RAPSS-HAD", "RPSS", "RSS"]
LINKAGE_FORMATS = ["VID-HOSP", "VID-IPP"]

# Fields of a platform export and the format of the lines they carry.
EXPORT_LINE_FIELDS = {
    "raas": "RAA", "rpss": "RPS", "iums": "FICUM-PSY",
    "tpspartiels": "FICHCOMP-TP", "isolconts": "FICHCOMP-ISO", "transps": "FICHCOMP",
}
EXPORT_CHAIN_FIELDS = {"anoipp": "ANO-HOSP", "anohosp": "ANO-HOSP"}
EXPORT_DEDUPLICATED = ["FICUM-PSY"]

# The character set trimmed from a field.
BLANKS = " \t\n\u000b\f\r\u0085\u00a0"

# Severities in increasing order.
SEVERITIES = ["Info", "Warning", "Error", "Blocker"]

# Field names looked up for ambulatory visits.
VISIT_ALIASES = {
    "ipp": ["IPP", "NUM_PATIENT", "ID_PATIENT"],
    "date": ["DATE_ACTE", "DATE_VENUE", "DATE", "DATE_SEANCE"],
    "um": ["UM", "NUM_UM", "UNITE_MEDICALE", "CODE_UM"],
    "site": ["SITE", "FINESS", "FINESS_GEO", "ETABLISSEMENT"],
}

# Column names of a structure file, in lower case.
STRUCTURE_COLUMNS = {
    "code": ["code", "id", "identifiant", "um", "code_um", "code_service"],
    "parent": ["parent", "parent_code", "code_parent", "rattache_a", "rattachement"],
    "label": ["label", "libelle", "libellé", "nom", "name", "designation", "lib_um", "libelle_um",
              "lib_service", "service_lib", "lib_pole", "lib_secteur"],
    "short_label": ["lib_um_court", "libelle_court", "lib_court", "abrege"],
    "level": ["level", "niveau", "type"],
}
STRUCTURE_FALLBACK = ["level", "code", "parent", "label"]
STRUCTURE_DELIMITERS = [";", ",", "\t", "|"]
SECTOR_CODE = r"(?i)^\s*(?:(\d{2,3})[-_\s]?)?([GIDPZ])[-_\s]?(\d{2,3})?\s*$"
SECTOR_KEYWORDS = [
    ("D", ["UMD", "MALADES DIFFICILES"]),
    ("P", ["UHSA", "PENITENTIAIRE", "PÉNITENTIAIRE"]),
    ("I", ["INFANTO", "PEDOPSY", "PÉDOPSY", "ENFANT", "ADOLESCENT"]),
    ("Z", ["INTERSECTO", "INTER-SECTO"]),
]

# The mark of a corrected file and the month folder.
CORRECTION_MARK = (
    r"([\s_\-]*-\s*corriger|[\s_\-]*corr(ig(e|é)|ection)?[\s_\-]*main[\s_\-]*|[\s_\-]*corrig(e|é)|[\s_\-]*corr\b)"
)
MONTH_FOLDER = r"(?i)^M\s*\d{1,2}$"

# Words of the official labels that locate the activity-line features.
RAA_FEATURE_WORDS = {
    "ipp": ["IDENTIFICATION PERMANENT"],
    "ddn": ["DATE DE NAISSANCE"],
    "date": ["DATE DE L", "ACTE"],
    "sexe": ["SEXE"],
    "forme": ["FORME D", "ACTIVITE"],
    "um": ["UNITE MEDICALE"],
    "secteur": ["SECTEUR"],
    "mode_legal": ["MODE LEGAL"],
    "nature": ["NATURE DE L", "ACTE"],
    "lieu": ["LIEU DE L", "ACTE"],
    "modalite": ["MODALITE DE REALISATION"],
    "categorie": ["CATEGORIE PROFESSIONNELLE"],
    "intervenants": ["NOMBRE D", "INTERVENANTS"],
    "liberal": ["LIBERAL"],
    "dp": ["DIAGNOSTIC PRINCIPAL"],
    "nda": ["NOMBRE DE DIAGNOSTICS"],
    "finess_geo": ["FINESS GEOGRAPHIQUE"],
}

# Supplementary billing lines.
Supplementary = namedtuple("Supplementary", "total finess stay code quantity decimals")
SUPPLEMENTARY = {
    "medicament": Supplementary(53, 9, 20, 9, 7, 3),
    "dispositif": Supplementary(50, 9, 20, 9, 4, 0),
}

# Headings of the transport report.
TRANSPORT_HEADINGS = [
    "Date commande", "UF", "Libellé - Uf", "Date paiement - Mnd", "Date de naissance", "Nom fournisseur",
    "Adresse fournisseur ligne 1", "Code postal fournisseur", "Ville fournisseur", "Nombre de kilomètres",
]
# Field widths of a composed transport line.
TRANSPORT_WIDTHS = {"uf": 4, "label": 30, "column_f": 20, "birth_date": 9, "trailing": 10}

# Alphabet of the pseudonyms.
TOKEN_ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"

# Layouts of the two central 2026 activity formats (name, start 1-based, length, label).
RAA_2026 = [
    ("NUMERO_FINESS_D_INSCRIPTION_EPMSI", 1, 9, "Numéro FINESS d’inscription ePMSI"),
    ("N_FINESS_GEOGRAPHIQUE", 10, 9, "N° FINESS géographique"),
    ("N_DE_FORMAT", 19, 3, "N° de format"),
    ("N_D_IDENTIFICATION_PERMANENT_DU_PATIENT", 22, 20, "N° d’identification permanent du patient (IPP)"),
    ("DATE_DE_NAISSANCE_DU_PATIENT", 42, 8, "Date de naissance du patient"),
    ("SEXE_DU_PATIENT", 50, 1, "Sexe du patient"),
    ("CODE_POSTAL_DE_RESIDENCE", 51, 5, "Code postal de résidence"),
    ("FORME_D_ACTIVITE", 56, 4, "Forme d'activité"),
    ("N_D_UNITE_MEDICALE", 60, 4, "N° d’unité médicale"),
    ("N_DE_SECTEUR_OU_DE_DISPOSITIF_INTERSECTO", 64, 5, "N° de secteur ou de dispositif intersectoriel"),
    ("MODE_LEGAL_DE_SOINS", 69, 1, "Mode légal de soins"),
    ("DATE_DE_L_ACTE", 70, 8, "Date de l’acte"),
    ("NATURE_DE_L_ACTE", 78, 2, "Nature de l’acte"),
    ("LIEU_DE_L_ACTE", 80, 3, "Lieu de l’acte"),
    ("MODALITE_DE_REALISATION_DE_L_ACTE", 83, 1, "Modalité de réalisation de l'acte"),
    ("CATEGORIE_PROFESSIONNELLE_DE_L_INTERVENA", 84, 1, "Catégorie professionnelle de l’intervenant"),
    ("NOMBRE_D_INTERVENANTS", 85, 1, "Nombre d’intervenants"),
    ("INDICATEUR_D_ACTIVITE_LIBERALE", 86, 1, "Indicateur d’activité libérale"),
    ("DIAGNOSTIC_PRINCIPAL_OU_MOTIF_DE_PRISE_E", 87, 8, "Diagnostic principal ou motif de prise en charge principale"),
    ("NOMBRE_DE_DIAGNOSTICS_ET_FACTEURS_ASSOCI", 95, 2, "Nombre de diagnostics et facteurs associés"),
]
RPS_2026 = RAA_2026[:8] + [
    ("N_DE_SEJOUR", 60, 20, "N° de séjour"),
    ("DATE_D_ENTREE_DE_SEJOUR", 80, 8, "Date d’entrée de séjour"),
    ("MODE_D_ENTREE_DE_SEJOUR", 88, 1, "Mode d’entrée de séjour"),
    ("PROVENANCE", 89, 1, "Provenance"),
    ("DATE_DE_SORTIE_DE_SEJOUR", 90, 8, "Date de sortie de séjour"),
    ("MODE_DE_SORTIE_DE_SEJOUR", 98, 1, "Mode de sortie de séjour"),
    ("DESTINATION", 99, 1, "Destination"),
    ("N_D_UNITE_MEDICALE", 100, 4, "N° d’unité médicale"),
    ("N_DE_SECTEUR_OU_DE_DISPOSITIF_INTERSECTO", 104, 5, "N° de secteur ou de dispositif intersectoriel"),
    ("MODE_LEGAL_DE_SOINS", 109, 1, "Mode légal de soins"),
    ("FILLER", 110, 1, "Filler"),
    ("DATE_DE_DEBUT_DE_SEQUENCE", 111, 8, "Date de début de séquence"),
    ("DATE_DE_FIN_DE_SEQUENCE", 119, 8, "Date de fin de séquence"),
    ("NOMBRE_DE_JOURS_DE_PRESENCE", 127, 3, "Nombre de jours de présence"),
    ("NOMBRE_DE_DEMI_JOURNEES_DE_PRESENCE", 130, 3, "Nombre de demi-journées de présence"),
    ("NOMBRE_DE_JOURS_D_ISOLEMENT_DE_DUREE_2H", 133, 3, "Nombre de jours d’isolement de durée >= 2h"),
    ("SCORE_DEPENDANCE_HABILLAGE_AVQ", 136, 1, "Score dépendance habillage (AVQ)"),
    ("SCORE_DEPENDANCE_DEPLACEMENT_LOCOMOTION", 137, 1, "Score dépendance déplacement/locomotion (AVQ)"),
    ("SCORE_DEPENDANCE_ALIMENTATION_AVQ", 138, 1, "Score dépendance alimentation (AVQ)"),
    ("SCORE_DEPENDANCE_CONTINENCE_AVQ", 139, 1, "Score dépendance continence (AVQ)"),
    ("SCORE_DEPENDANCE_COMPORTEMENT_AVQ", 140, 1, "Score dépendance comportement (AVQ)"),
    ("SCORE_DEPENDANCE_COMMUNICATION_AVQ", 141, 1, "Score dépendance communication (AVQ)"),
    ("INDICATEUR_D_ACCOMPAGNEMENT_THERAPEUTIQU", 142, 1, "Indicateur d’accompagnement thérapeutique en milieu scolaire"),
    ("DIAGNOSTIC_PRINCIPAL_OU_MOTIF_DE_PRISE_E", 143, 8, "Diagnostic principal ou motif de prise en charge principale"),
    ("NOMBRE_DE_DIAGNOSTICS_ET_FACTEURS_ASSOCI", 151, 2, "Nombre de diagnostics et facteurs associés (nDA)"),
    ("NOMBRE_D_ACTES_CCAM_NZA", 153, 2, "Nombre d’actes CCAM (nZA)"),
]
