"""Word forms of the South-Slavic operators."""

from __future__ import annotations

# Male participles and their female forms.
FEMALE_FORMS = {
    "bio": "bila", "išao": "išla", "otišao": "otišla", "prišao": "prišla", "ušao": "ušla",
    "izašao": "izašla", "prošao": "prošla", "sišao": "sišla", "dočekao": "dočekala", "došao": "došla",
    "našao": "našla", "pronašao": "pronašla", "rekao": "rekla", "kazao": "kazala", "govorio": "govorila",
    "progovorio": "progovorila", "odgovorio": "odgovorila", "vidio": "vidjela", "gledao": "gledala", "pogledao": "pogledala",
    "ugledao": "ugledala", "primijetio": "primijetila", "čuo": "čula", "htio": "htjela", "mogao": "mogla",
    "morao": "morala", "smio": "smjela", "znao": "znala", "trebao": "trebala", "imao": "imala",
    "dao": "dala", "uzeo": "uzela", "sjeo": "sjela", "legao": "legla", "ustao": "ustala",
    "stao": "stala", "sjedio": "sjedila", "stajao": "stajala", "krenuo": "krenula", "okrenuo": "okrenula",
    "trčao": "trčala", "hodao": "hodala", "bježao": "bježala", "pobjegao": "pobjegla", "pao": "pala",
    "počeo": "počela", "prestao": "prestala", "nastavio": "nastavila", "vratio": "vratila", "ostao": "ostala",
    "mislio": "mislila", "osjetio": "osjetila", "osjećao": "osjećala", "razumio": "razumjela", "shvatio": "shvatila",
    "pomislio": "pomislila", "sjetio": "sjetila", "zaboravio": "zaboravila", "radio": "radila", "uradio": "uradila",
    "napravio": "napravila", "odlučio": "odlučila", "pokušao": "pokušala", "ponudio": "ponudila", "prihvatio": "prihvatila",
    "odbio": "odbila", "zamolio": "zamolila", "pozvao": "pozvala", "zvao": "zvala", "nazvao": "nazvala",
    "nosio": "nosila", "tražio": "tražila", "klimnuo": "klimnula", "slegnuo": "slegnula", "osmjehnuo": "osmjehnula",
    "nasmijao": "nasmijala", "smijao": "smijala", "plakao": "plakala", "vikao": "vikala", "šaputao": "šaputala",
    "otvorio": "otvorila", "zatvorio": "zatvorila", "spustio": "spustila", "podigao": "podigla", "čitao": "čitala",
    "pisao": "pisala", "pjevao": "pjevala", "spavao": "spavala", "jeo": "jela", "pio": "pila",
    "posjetio": "posjetila", "dobio": "dobila", "izgubio": "izgubila", "pričao": "pričala", "pitao": "pitala",
    "čekao": "čekala",
}

# Forms that do not exist, and what they stand for.
WRONG_FORMS = {
    "voljevao": "volio", "voljevala": "voljela", "voljevali": "voljeli", "hodavao": "hodao", "hodavala": "hodala",
    "hodavali": "hodali", "gledavao": "gledao", "gledavala": "gledala", "gledavali": "gledali", "vidjevao": "vidio",
    "vidjevala": "vidjela", "vidjevali": "vidjeli", "čujevao": "čuo", "čujevala": "čula", "čujevali": "čuli",
    "spavivao": "spavao", "spavivala": "spavala", "spavivali": "spavali", "trčavao": "trčao", "trčavala": "trčala",
    "trčavali": "trčali", "pjevavao": "pjevao", "pjevavala": "pjevala", "pjevavali": "pjevali", "govorivao": "govorio",
    "govorivala": "govorila", "govorivali": "govorili", "mislivao": "mislio", "mislivala": "mislila", "mislivali": "mislili",
    "nosivao": "nosio", "nosivala": "nosila", "nosivali": "nosili", "pisivao": "pisao", "čitavivao": "čitao",
    "radivao": "radio", "radivala": "radila", "radivali": "radili", "stavivao": "stavljao", "stavivala": "stavljala",
    "uzimivao": "uzimao", "uzimivala": "uzimala", "davivao": "davao", "davivala": "davala", "pravivao": "pravio",
    "pravivala": "pravila", "tražavao": "tražio", "tražavala": "tražila", "uzdisnuo": "uzdahnuo", "popivajući": "ispijajući",
    "popivao": "pio", "izlazivao": "izlazio", "ulazivao": "ulazio", "prolazivao": "prolazio", "ostajivao": "ostajao",
    "sijedio": "sjedio", "donesavši": "donijevši", "iznesavši": "iznijevši", "odnesavši": "odnijevši", "prinesavši": "prinijevši",
    "zanesavši": "zanijevši", "memorativao": "pamtio", "procesivao": "obrađivao", "skeniravao": "skenirao", "uploadavao": "učitavao",
    "downloadavao": "preuzimao", "connectavao": "spajao", "logavao": "bilježio",
}

# Patterns of words whose form is doubtful.
DOUBTFUL = [r"\w+[aei]vao", r"\w+[aei]vala", r"\w+ivao", "popivajući", "uzdisnuo", "sijedio", r"\w+(avao|ivao|evao)"]
# Words that the patterns find and that are right.
RIGHT = [
    "poznavao", "poznavala", "poznavali", "ostavljao", "ostavljala", "ostavljali",
    "ostajao", "ostajala", "ostajali", "prepoznavao", "prepoznavala", "prepoznavali",
    "prikazivao", "prikazivala", "prikazivali", "nazivao", "nazivala", "nazivali",
    "zahtijevao", "zahtijevala", "zahtijevali", "primjećivao", "primjećivala", "primjećivali",
    "pokušavao", "pokušavala", "pokušavali", "osjećao", "osjećala", "osjećali",
    "nalazivao", "čitavao", "pisivao", "dolazivao", "odlazivao", "saznavao",
    "saznavala", "saznavali", "doživljavao", "doživljavala", "doživljavali", "razmišljao",
    "razmišljala", "razmišljali", "svladavao", "svladavala", "svladavali", "savladavao",
    "savladavala", "savladavali", "pokazivao", "pokazivala", "pokazivali", "smijao",
    "smijala", "smijali", "nasmijao", "nasmijala", "nasmijali", "bojao",
    "bojala", "bojali", "stajao", "stajala", "stajali", "sijao",
    "sijala", "sijali", "pazio", "pazila", "pazili",
]

# Capitalised words that are not names; titles and the gender that they tell.
STOP_NAMES = [
    "Ali", "Jer", "Dok", "Kad", "Što", "Koji", "Koja", "Koje", "Ovaj",
    "Ova", "Ovo", "Taj", "Ta", "To", "Jedan", "Jedna", "Ovdje", "Tamo",
    "Gdje", "Ili", "Nego", "Dakle", "Naime", "Ipak", "Međutim", "Također", "Tek",
    "Već", "Baš", "Samo", "Sve", "Svi", "Svaki", "Svaka", "Svako", "Nije",
    "Nema", "Bio", "Bila", "Bili", "Rekao", "Rekla", "Otišao", "Otišla",
]
TITLES = {
    "gospođa": "Ž", "gđa": "Ž", "mrs": "Ž", "mrs.": "Ž", "ms": "Ž", "ms.": "Ž", "lady": "Ž", "miss": "Ž",
    "gospodin": "M", "g.": "M", "mr": "M", "mr.": "M", "sir": "M", "lord": "M", "dr": "M", "dr.": "M",
}
