"""Record specs of the demonstrations: the shipped activity layouts and a short linkage layout."""

from functools import cache

from ligneo.catalogue import RAA_2026, RPS_2026
from ligneo.sources.layouts import collect_specs, layouts_from_fields

# A few fields of the linkage record, enough for the demonstrations; the full layout is a descriptor file.
VID_SHORT = [
    ("NIR", 1, 13, "N° immatriculation assuré"),
    ("CLE_NIR", 14, 2, "Clé du N° immatriculation"),
    ("DATE_NAISSANCE", 20, 8, "Date de naissance du bénéficiaire"),
    ("NUMERO_SEJOUR", 29, 20, "N° administratif de séjour"),
    ("FINESS", 53, 9, "N° FINESS d’inscription e-PMSI"),
    ("IPP", 354, 20, "Numéro d’identification permanent du patient (IPP)"),
    ("NOMBRE_DMT", 467, 4, "Nombre de disciplines de prestations (N)"),
    ("DMT", 471, 3, "Discipline de prestations"),
    ("MODE_TRAITEMENT", 474, 2, "Mode de traitement"),
    ("DATE_DEBUT", 476, 8, "Date de début de séjour"),
    ("DATE_FIN", 484, 8, "Date de fin de séjour"),
    ("MONTANT", 492, 29, "Montant"),
]


def demo_layouts(spark):
    return (
        layouts_from_fields(spark, "RAA", RAA_2026, 2026, "RAA.2026")
        .unionByName(layouts_from_fields(spark, "RPS", RPS_2026, 2026, "RPS.2026"))
        .unionByName(layouts_from_fields(spark, "VID-HOSP", VID_SHORT, 2026, "VID.2026"))
    )


@cache
def demo_specs(spark):
    return collect_specs(demo_layouts(spark))
