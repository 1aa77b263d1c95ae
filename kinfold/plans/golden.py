"""Inputs and outcomes of normalisation that must hold."""

from __future__ import annotations

# Fixed values.
NAMES = [
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "ram marketing pvt ltd", "ram marketing"),
    ("ब्लैक कंस्ट्रक्शन प्रा. लि.", "blaik kanstraksan pvt ltd", "blaik kanstraksan"),
    ("-- Holloway Peak Inc Seafood", "holloway peak inc seafood", "holloway peak seafood"),
    ("5umit (india) Limited", "sumit india ltd", "sumit"),
    ("Manchester H0rizon Assets Harbor Inc", "manchester horizon assets harbor inc", "manchester horizon assets harbor"),
    ("Premier Technology Pvt-Limited", "premier technology pvt ltd", "premier technology"),
    ("Mr Snehal Engineering Private  Limited", "mr snehal engineering pvt ltd", "snehal engineering"),
    ("Etoile SAS  et Associés", "etoile sas et associes", "etoile et associes"),
    ("Aromatic & Brothers Pvt. Ltd.", "aromatic and brothers pvt ltd", "aromatic and brothers"),
    ("Ridge LP [Center] #17196", "ridge lp center 17196", "ridge"),
    ("wilfordhancock.com", "wilfordhancock", "wilfordhancock"),
    ("SHARMA ELECTRONICS PRIVATE LIMITED", "sharma electronics pvt ltd", "sharma electronics"),
    ("Ciraonyx a/k/a VL Creations Private Limited", "ciraonyx vl creations pvt ltd", "ciraonyx"),
    ("cs1464.com", "cs1464", "cs1464"),
    ("Cl0guh LLC", "cloguh llc", "cloguh"),
    ("Achintya & Co", "achintya and co", "achintya"),
]
ADDRESSES = [
    ("KH NO. -570/13, NEW DELHI, WEST DELHI, Delhi", "India", "delhi", "west delhi", "13 570"),
    ("GREENSBORO, NC, 19 1/2 STARDUST TRAIL", "US", "north carolina", "greensboro", "1 2 19"),
    ("KS, 0549 OAK STREET, COLUMBUS", "US", "kansas", "columbus", "549"),
    ("SURVEY NO. 376, MORBI-JETPURA ROAD, SHAPAR, MORBI, RAJKOT, ગુજરાત", "India", "gujarat", "rajkot", "376"),
    ("NO 96 J - 141 SAKET, NEW DELHI, दिल्ली", "India", "delhi", "new delhi", "96 141"),
    ("Nouvelle-Aquitaine, PESSAC, 18 AV PIERRE CASTAING", "France", "nouvelle-aquitaine", "pessac", "18"),
    ("No 752 40A, Calcutta, Howrah, WB", "India", "west bengal", "howrah", "40 752"),
]
ADDRESS_TEXTS = [
    ("105 Elm Street, Morganton, North Carolina", "US", "105 elm st morganton"),
    ("4 Rue René Guillouzo, Saint-Nazaire, Pays de la Loire", "France", "4 rue rene guillouzo st nazaire"),
    ("18 R de Picardie, Roubaix", "France", "18 rue de picardie roubaix"),
    ("N° 161 BOULEVARD ROBERT SCHUMAN, NANTES", "France", "161 boulevard robert schuman nantes"),
    ("12 Some Road, Springfield", "Atlantis", "12 some road springfield"),
]


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """``rows`` as a SQL query."""
    quoted = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS t({', '.join(columns)})"
