"""Word lists, patterns and constants that results depend on, in the order in which they apply."""

CITIES = [  # fixed values: key, latitude, longitude, province, name; the first that matches counts
    ("cadiz", 36.5271, -6.2886, "Cádiz", "Cádiz (UCA)"), ("madrid", 40.4168, -3.7038, "Madrid", "Madrid"), ("barcelona", 41.3851, 2.1734, "Barcelona", "Barcelona"),
    ("sevilla", 37.3891, -5.9845, "Sevilla", "Sevilla"), ("valencia", 39.4699, -0.3763, "Valencia", "Valencia"), ("zaragoza", 41.6488, -0.8896, "Zaragoza", "Zaragoza"),
    ("malaga", 36.7213, -4.4214, "Málaga", "Málaga"), ("granada", 37.1773, -3.5986, "Granada", "Granada"), ("cordoba", 37.8882, -4.7794, "Córdoba", "Córdoba"),
    ("santiago", 42.8782, -8.5448, "A Coruña", "Santiago de Compostela"), ("salamanca", 40.9701, -5.6635, "Salamanca", "Salamanca"), ("bilbao", 43.2630, -2.9350, "Bizkaia", "Bilbao"),
    ("valladolid", 41.6523, -4.7245, "Valladolid", "Valladolid"), ("alicante", 38.3452, -0.4815, "Alicante", "Alicante"), ("murcia", 37.9922, -1.1307, "Murcia", "Murcia"),
    ("oviedo", 43.3619, -5.8494, "Asturias", "Oviedo"), ("santander", 43.4623, -3.8099, "Cantabria", "Santander"), ("palma", 39.5696, 2.6502, "Illes Balears", "Palma de Mallorca"),
    ("laspalmas", 28.1235, -15.4363, "Las Palmas", "Las Palmas de Gran Canaria"), ("badajoz", 38.8794, -6.9707, "Badajoz", "Badajoz"), ("caceres", 39.4753, -6.3724, "Cáceres", "Cáceres"),
    ("almeria", 36.8340, -2.4637, "Almería", "Almería"), ("jaen", 37.7796, -3.7849, "Jaén", "Jaén"), ("huelva", 37.2614, -6.9447, "Huelva", "Huelva"),
    ("leon", 42.5987, -5.5671, "León", "León"), ("burgos", 42.3439, -3.6969, "Burgos", "Burgos"), ("zamora", 41.5035, -5.7445, "Zamora", "Zamora"),
    ("avila", 40.6566, -4.6818, "Ávila", "Ávila"), ("segovia", 40.9429, -4.1088, "Segovia", "Segovia"), ("soria", 41.7636, -2.4649, "Soria", "Soria"),
    ("palencia", 42.0096, -4.5288, "Palencia", "Palencia"), ("lugo", 43.0097, -7.5568, "Lugo", "Lugo"), ("ourense", 42.3358, -7.8639, "Ourense", "Ourense"),
    ("pontevedra", 42.4310, -8.6446, "Pontevedra", "Pontevedra"), ("vigo", 42.2406, -8.7207, "Pontevedra", "Vigo"), ("coruna", 43.3623, -8.4115, "A Coruña", "A Coruña"),
    ("castellon", 39.9864, -0.0513, "Castellón", "Castellón"), ("girona", 41.9794, 2.8214, "Girona", "Girona"), ("lleida", 41.6176, 0.6200, "Lleida", "Lleida"),
    ("tarragona", 41.1189, 1.2445, "Tarragona", "Tarragona"), ("huesca", 42.1401, -0.4089, "Huesca", "Huesca"), ("teruel", 40.3456, -1.1065, "Teruel", "Teruel"),
    ("guadalajara", 40.6337, -3.1674, "Guadalajara", "Guadalajara"), ("toledo", 39.8628, -4.0273, "Toledo", "Toledo"), ("cuenca", 40.0704, -2.1374, "Cuenca", "Cuenca"),
    ("ciudadreal", 38.9848, -3.9274, "Ciudad Real", "Ciudad Real"), ("albacete", 38.9942, -1.8585, "Albacete", "Albacete"), ("logrono", 42.4627, -2.4445, "La Rioja", "Logroño"),
    ("pamplona", 42.8125, -1.6458, "Navarra", "Pamplona"), ("donostia", 43.3183, -1.9812, "Gipuzkoa", "San Sebastián"), ("vitoria", 42.8467, -2.6716, "Álava", "Vitoria-Gasteiz"),
    ("tenerife", 28.4636, -16.2518, "Santa Cruz de Tenerife", "San Cristóbal de La Laguna"), ("ceuta", 35.8894, -5.3198, "Ceuta", "Ceuta"), ("melilla", 35.2923, -2.9381, "Melilla", "Melilla"),
    ("cartagena", 37.6057, -0.9913, "Murcia", "Cartagena"), ("elche", 38.2699, -0.7125, "Alicante", "Elche"),
]

# Names of regions, by substrings in lower case; all the groups of an entry must be met.
REGIONS = [
    ([["andaluc"]], "Andalucía"), ([["arag"]], "Aragón"), ([["astur"]], "Principado de Asturias"), ([["balear", "illes"]], "Illes Balears"),
    ([["canar"]], "Canarias"), ([["cantabr"]], "Cantabria"), ([["castilla y le", "castilla-le", "león", "leon"]], "Castilla y León"),
    ([["castilla"], ["mancha"]], "Castilla-La Mancha"), ([["catalu"]], "Cataluña"), ([["valenc"]], "Comunitat Valenciana"), ([["extrem"]], "Extremadura"),
    ([["galic"]], "Galicia"), ([["madrid"]], "Comunidad de Madrid"), ([["murci"]], "Región de Murcia"), ([["navarr"]], "Comunidad Foral de Navarra"),
    ([["vasco", "euskad"]], "País Vasco"), ([["rioja"]], "La Rioja"), ([["uned", "nacional", "no aplicable"]], "UNED"),
]

# Euro per credit at the first to fourth enrolment of degrees, regulated and other masters; doctoral fee; other fees; decree.
TARIFFS = {
    "Andalucía": ((12.62, 25.24, 54.4, 75.6), (13.68, 27.36, 59.0, 82.0), (13.68, 27.36, 59.0, 82.0), 60.3, 59.1, "Decreto de Precios Públicos de las Universidades Públicas de Andalucía"),
    "Aragón": ((18.9, 32.13, 69.3, 96.25), (22.4, 38.08, 82.15, 114.1), (34.5, 58.65, 126.5, 175.7), 185.0, 44.0, "Decreto de Tarifas Universitarias de la Comunidad Autónoma de Aragón"),
    "Principado de Asturias": ((16.15, 27.45, 59.2, 82.2), (21.5, 36.55, 78.85, 109.5), (29.0, 49.3, 106.35, 147.7), 150.0, 42.0, "Decreto de Precios Públicos del Principado de Asturias"),
    "Illes Balears": ((16.4, 27.88, 60.15, 83.5), (21.8, 37.06, 79.95, 111.05), (32.0, 54.4, 117.35, 163.0), 160.0, 45.0, "Decret de Preus Públics de les Illes Balears"),
    "Canarias": ((12.5, 21.25, 45.8, 63.65), (14.2, 24.14, 52.05, 72.3), (18.5, 31.45, 67.85, 94.2), 120.0, 40.0, "Decreto de Precios Públicos de la Comunidad Autónoma de Canarias"),
    "Cantabria": ((14.8, 25.16, 54.28, 75.38), (19.8, 33.66, 72.6, 100.85), (28.0, 47.6, 102.7, 142.6), 145.0, 43.0, "Decreto de Precios Públicos del Gobierno de Cantabria"),
    "Castilla y León": ((17.8, 30.26, 65.28, 90.65), (23.5, 39.95, 86.2, 119.7), (35.0, 59.5, 128.35, 178.25), 200.0, 50.0, "Decreto de Precios Públicos de la Junta de Castilla y León"),
    "Castilla-La Mancha": ((15.5, 26.35, 56.85, 78.95), (18.2, 30.94, 66.75, 92.7), (26.0, 44.2, 95.35, 132.45), 140.0, 45.0, "Decreto de Precios Públicos de Castilla-La Mancha"),
    "Cataluña": ((18.46, 31.38, 67.7, 94.0), (27.67, 47.04, 101.48, 140.9), (41.17, 69.99, 150.98, 209.65), 401.12, 69.8, "Decret de Preus Públics de la Generalitat de Catalunya"),
    "Comunitat Valenciana": ((15.1, 25.67, 55.37, 76.9), (20.2, 34.34, 74.07, 102.88), (35.34, 60.08, 129.6, 180.0), 180.0, 46.0, "Decret de Taxes Universitàries de la Generalitat Valenciana"),
    "Extremadura": ((14.1, 23.97, 51.71, 71.82), (16.5, 28.05, 60.5, 84.05), (24.0, 40.8, 88.0, 122.25), 130.0, 41.0, "Decreto de Precios Públicos de la Junta de Extremadura"),
    "Galicia": ((11.89, 20.21, 43.6, 60.56), (13.5, 22.95, 49.5, 68.75), (18.2, 30.94, 66.75, 92.7), 110.0, 38.0, "Decreto de Prezos Públicos da Xunta de Galicia"),
    "Comunidad de Madrid": ((21.39, 36.36, 78.44, 108.94), (26.84, 45.63, 98.42, 136.7), (45.02, 76.53, 165.1, 229.3), 390.0, 65.0, "Decreto del Consejo de Gobierno de la Comunidad de Madrid"),
    "Región de Murcia": ((15.2, 25.84, 55.74, 77.42), (19.5, 33.15, 71.5, 99.32), (29.0, 49.3, 106.35, 147.7), 160.0, 45.0, "Decreto de Precios Públicos de la Región de Murcia"),
    "Comunidad Foral de Navarra": ((17.5, 29.75, 64.17, 89.13), (24.0, 40.8, 88.0, 122.25), (33.0, 56.1, 121.0, 168.1), 220.0, 48.0, "Decreto Foral de Tarifas Universitarias de Navarra"),
    "País Vasco": ((16.8, 28.56, 61.6, 85.56), (22.0, 37.4, 80.67, 112.05), (31.0, 52.7, 113.67, 157.9), 210.0, 47.0, "Decreto de Precios Públicos del Gobierno Vasco / Eusko Jaurlaritza"),
    "La Rioja": ((16.2, 27.54, 59.4, 82.51), (21.0, 35.7, 76.99, 106.96), (28.5, 48.45, 104.5, 145.15), 175.0, 44.0, "Decreto de Precios Públicos del Gobierno de La Rioja"),
    "UNED": ((14.5, 24.65, 53.17, 73.85), (22.0, 37.4, 80.67, 112.05), (30.0, 51.0, 110.0, 152.8), 190.0, 40.0, "Orden Ministerial de Precios Públicos de la UNED"),
}

# Fields of knowledge, by substrings of the request, with the titles' pattern.
FIELDS = [
    (["salud"], "médic|medic|salud|enferm|psicol|farmac|fisioter|odontol|veterin|nutric|bioméd|podol|terapia"),
    (["ingenier", "arquitect", "tecnolog"], "ingenier|informát|computac|telecomunic|arquitect|industrial|software|aeronáut|robótic|electr"),
    (["social", "jurid", "derecho"], "derecho|administrac|empresa|econom|marketing|educac|magisterio|pedagog|comunicac|periodis|criminol|turismo"),
    (["arte", "humanid"], "historia|filolog|filosof|lengua|arte|música|traducc|humanid|literat|arqueol"),
    (["ciencia", "experimental"], "físic|químic|matemát|biolog|geolog|biotecnol|ciencias del mar|estadíst|bioquím"),
]

# Types of courses by substrings.
SUBJECT_TYPES = [
    (["básica", "basica", "fb"], "FB"), (["optativa", "op"], "OP"), (["práctica", "practica", "pe", "externa"], "PE"),
    (["tfg", "tfm", "trabajo fin", "trabajo de fin", "trabajo final", "proyecto fin", "proyecto de fin"], "TFG/TFM"),
]

# Whole forms of the years 1 to 6.
YEARS = [
    ["1", "1º", "1.º", "1er", "primer", "primero", "primer curso", "1r", "1r curs", "i", "curso 1", "año 1"],
    ["2", "2º", "2.º", "2do", "2n", "segundo", "segon", "segundo curso", "2n curs", "ii", "curso 2", "año 2"],
    ["3", "3º", "3.º", "3er", "3r", "tercer", "tercero", "tercer curso", "3r curs", "iii", "curso 3", "año 3"],
    ["4", "4º", "4.º", "4to", "4t", "cuarto", "quart", "cuarto curso", "4t curs", "iv", "curso 4", "año 4"],
    ["5", "5º", "5.º", "5to", "5è", "quinto", "cinquè", "quinto curso", "5è curs", "v", "curso 5", "año 5"],
    ["6", "6º", "6.º", "6to", "6è", "sexto", "sisè", "sexto curso", "6è curs", "vi", "curso 6", "año 6"],
]
# Terms, by substrings (yearly, part) and whole forms.
TERM_YEARLY = ["anual", "an", "1 y 2", "1 y 2º", "1-2", "curso completo", "anuales"]
TERM_ODD = ["1", "1º", "1.º", "1c", "1s", "1er", "primer", "primero", "1.er", "3", "5", "7", "s1", "c1"]
TERM_ODD_PART = [
    "1er", "1º cuat", "1.º cuat", "1.º sem", "1er sem", "primer cuat", "primer sem", "semestre 1", "semestre 3", "semestre 5", "semestre 7",
    "cuatrimestre 1", "cuatrimestre 3", "cuatrimestre 5", "cuatrimestre 7",
]
TERM_EVEN = ["2", "2º", "2.º", "2c", "2s", "2do", "2º cuat", "2.º cuat", "2.º sem", "2do sem", "segundo", "segundo cuat", "segundo sem", "4", "6", "8", "s2", "c2"]
TERM_EVEN_PART = [
    "2º", "2do", "segundo", "semestre 2", "semestre 4", "semestre 6", "semestre 8", "cuatrimestre 2", "cuatrimestre 4", "cuatrimestre 6", "cuatrimestre 8",
]

# States and levels of degrees, on folded text.
INACTIVE = ["extinguid", "extincion", "extinta", "extinto", "no vigente", "sin docencia", "baja", "derogad", "cancelad", "eliminad", "revocad", "suspendid", "caducad", "desestimad", "sustituid", "no impartid", "sin efecto", "cierre", "cerrad", "archivo"]
ACTIVE = ["vigente", "impartiendose", "autorizad", "renovad", "acreditad", "alta", "publicad", "b.o.e", "boe", "inscrit"]
OLD_LEVELS = ["solo segundo ciclo", "ciclo corto", "ciclo largo", "primer ciclo", "primer y segundo ciclo", "pre-bolonia", "rd 56/2005"]
OLD_TITLES = ["licenciado", "licenciada", "diplomado", "diplomada", "ingeniero tecnico", "ingeniera tecnica", "arquitecto tecnico", "arquitecta tecnica"]

# Required credits.
SPECIAL_DEGREES = ["veterinaria", "farmacia", "odontología", "odontologia", "arquitectura", "doble", "simultaneidad", "pceo"]
ENGINEERING_MASTERS = ["ingeniería industrial", "ingenieria industrial", "ingeniería de caminos", "ingenieria de caminos", "ingeniería de telecomunicación", "ingenieria de telecomunicacion", "ingeniería aeronáutica", "ingenieria aeronautica", "ingeniería agronómica", "ingenieria agronomica", "ingeniería naval", "ingenieria naval", "ingeniería de montes", "ingenieria de montes"]
LAW_MASTERS = ["abogacía", "abogacia", "psicología general sanitaria", "psicologia general sanitaria"]
REGULATED_MASTERS = ["abogacía", "abogacia", "profesorado", "profesor", "secundaria", "ingeniería de caminos", "ingeniería industrial", "ingeniería de telecomunicación", "ingeniería aeronáutica", "ingeniería agronómica", "ingeniería naval", "ingeniería de montes", "arquitectura", "psicología general sanitaria", "psicologia general sanitaria"]

# Labels and patterns of a credit summary.
CREDIT_SUMMARY = [
    ("Formación Básica", r"(?:formaci[oó]n b[aá]sica|fb)\s*[:\.\-]?\s*(\d+)"),
    ("Obligatorias", r"(?:obligatoria[s]?|ob)\s*[:\.\-]?\s*(\d+)"),
    ("Optativas", r"(?:optativa[s]?|op)\s*[:\.\-]?\s*(\d+)"),
    ("Prácticas Externas", r"(?:pr[aá]ctica[s]?|pe)\s*[:\.\-]?\s*(\d+)"),
    ("Trabajo Fin de Grado / Máster", r"(?:trabajo fin de|tfg|tfm)\s*[:\.\-]?\s*(\d+)"),
    ("Créditos Totales", r"(?:total|cr[eé]ditos totales)\s*[:\.\-]?\s*(\d+)"),
]

# Signs of text set in mirror writing.
MIRRORED_ENDS = ["odarG", "retsáM", "retsaM", "aígolocisP", "acitámrofnI", "aicneiC", "ohcereD"]
MIRRORED_PARTS = [" ne odarG", " ne retsáM", " aL ne "]

# Official hosts that have moved or are misspelt, and those that are only served securely.
HOSTS = {
    "portaldogc.gencat.cat": "dogc.gencat.cat", "www.boa.aragon.es": "boa.aragon.es", "bocm.es": "bocm.madrid.org", "www.bocm.es": "bocm.madrid.org", "wwww.bocm.es": "bocm.madrid.org",
    "bocyl.jcyl.es": "bocyl.jcyl.es", "www.bocyl.jcyl.es": "bocyl.jcyl.es", "www.dogv.gva.es": "dogv.gva.es", "doe.gobex.es": "doe.juntaex.es", "boe.es": "www.boe.es",
    "ww.boe.es": "www.boe.es", "www.boe.es": "www.boe.es", "wwww.boe.es": "www.boe.es", "wwwww.boe.es": "www.boe.es", "vwww.boe.es": "www.boe.es", "pww.boe.es": "www.boe.es", "'www.boe.es": "www.boe.es",
}
HOST_PATTERNS = [
    (r"^(?:w{1,8}|vwww|pww|'www)\.boe\.es$", "www.boe.es"), (r"^(?:w{1,8})\.bocm\.es$", "bocm.madrid.org"), (r"^(?:w{1,8})\.boa\.aragon\.es$", "boa.aragon.es"),
    (r"^(?:w{1,8})\.dogv\.gva\.es$", "dogv.gva.es"), (r"^(?:w{1,8})\.bocyl\.jcyl\.es$", "bocyl.jcyl.es"),
]
SECURE_HOSTS = ["dogc.gencat.cat", "boe.es", "educacion.gob.es", "bocm.madrid.org", "bocyl.jcyl.es", "dogv.gva.es", "boa.aragon.es", "doe.juntaex.es"]

# Patterns of prices in running text, in the order in which they are tried.
CREDIT_PRICE = [r"(?:precio|coste|importe|valor)\s*(?:del)?\s*(?:crédito|ects)\D*?(\d{2,4}(?:[.,]\d{1,2})?)\s*€?", r"(\d{2,4}(?:[.,]\d{1,2})?)\s*€?\s*/\s*(?:crédito|ects|cr)", r"(\d{2,4}(?:[.,]\d{1,2})?)\s*€?\s*por\s*crédito", r"(\d{2,4}(?:[.,]\d{1,2})?)\s*€\s*ects"]
TIER_PRICE = [
    [r"(?:segunda|2ª|2a)\s*matrícula\D*?(\d{2,4}(?:[.,]\d{1,2})?)\s*€?", r"crédito\s*repetidor\D*?(\d{2,4}(?:[.,]\d{1,2})?)\s*€?"],
    [r"(?:tercera|3ª|3a)\s*matrícula\D*?(\d{2,4}(?:[.,]\d{1,2})?)\s*€?"], [r"(?:cuarta|4ª|4a)\s*matrícula\D*?(\d{2,4}(?:[.,]\d{1,2})?)\s*€?"],
]
ANNUAL_PRICE = [r"(?:precio|importe|coste|tuition|cuota|honorarios)\s*(?:total|anual|por\s*curso)?\D*?(\d{1,2}[.,]\d{3}|\d{4,5})\s*€?", r"(\d{1,2}[.,]\d{3}|\d{4,5})\s*€?\s*/\s*(?:año|curso|anual)", r"(\d{1,2}[.,]\d{3}|\d{4,5})\s*€\s*(?:al\s*año|por\s*curso)"]

# Words in addresses and labels of links, by level of study.
LEVEL_WORDS = {
    "grado": (["grado", "grau", "grao", "gradua", "bachelor"], ["dobles-grados", "/grados", "/grado/", "/estudios/grado", "oferta-academica/grados", "oferta-formativa/grados", "dobles-graus", "/graus", "/grau/", "/estudis/grau", "oferta-formativa/graus", "estudis-de-grau", "dobres-graos", "/graos", "/grao/", "/estudos/grao", "estudos-de-grao", "gradu-bikoitzak", "/graduak", "/gradua/", "gradu-ikasketak", "bachelor-degree", "/undergraduate", "/bachelor/", "study-plans", "/degrees/"], ["grado", "grau", "grao", "gradua", "bachelor", "undergraduate"]),
    "master": (["master", "máster", "màster"], ["masteres-universitarios", "masteres-oficiales", "/masteres", "/master/", "/posgrado", "/postgrado", "masters-universitaris", "estudis-de-master", "/masters", "/postgrau", "estudos-de-posgrao", "/posgrao", "unibertsitate-masterra", "/masterrak", "/graduondokoa", "master-degrees", "master-programs", "/postgraduate/", "/graduate/"], ["master", "máster", "màster", "posgrado", "postgrado", "postgrau", "posgrao", "postgraduate"]),
    "doctor": (["doctor", "doutor", "doktor", "phd"], ["programas-de-doctorado", "/doctorado", "/escuela-doctorado", "programes-de-doctorat", "/doctorat", "escola-de-doctorat", "programas-de-doutoramento", "/doutoramento", "escola-de-doutoramento", "doktorego-programak", "/doktoregoa", "doktorego-eskola", "doctoral-programmes", "doctoral-programs", "/phd/"], ["doctor", "doutoramento", "doktoregoa", "phd"]),
}
OFFER_ADDRESS = ["oferta-academica", "oferta_academica", "oferta-formativa", "planes-de-estudio", "plan_estudios", "pla-destudis", "pla-estudis", "plans-destudi", "plano-de-estudos", "ikasketa-plana", "titulos-oficiales", "estudios-oficiales", "estudis-oficials", "titulacions-oficials", "titulacions", "malla-curricular", "academic-offer", "academic-programs", "curriculum", "syllabus"]
OFFER_LABEL = ["oferta académica", "oferta academica", "oferta formativa", "planes de estudio", "pla d'estudis", "plano de estudos", "ikasketa plana", "titulaciones oficiales", "estudios oficiales", "study plans", "academic programs"]
OFFICE_ADDRESS = ["/administracion", "/oficina-del-estudiante", "/servicios", "/alojamiento", "/transporte", "/seguro-escolar", "/becas", "/pau", "/noticias", "/prensa", "/eventos", "/actividades", "/categoria", "/wp-content", "/galeria", "/agenda", "/administracio", "/oficina-de-lestudiant", "/serveis", "/allotjament", "/beques", "/oficina-do-estudante", "/servizos", "/aloxamento", "/bolsas", "/administrazioa", "/ikaslearen-bulegoa", "/zerbitzuak", "/ostatua", "/bekak", "/administration", "/student-office", "/services", "/accommodation", "/scholarships", "/news", "/press", "/events"]

# Words that make a row of a course table its header, and those that give a column its role (in this order).
GRID_HEADER = ["asignatura", "denominaci", "materia", "crédito", "credito", "ects", "carácter", "caracter", "curso", "módulo", "modulo"]
GRID_ROLES = {
    "subject": ["asignatura", "denominaci", "nombre", "actividad formativa", "unidad curricular"], "topic": ["materia", "módulo", "modulo"], "ects": ["crédito", "credito", "ects"],
    "kind": ["carácter", "caracter", "tipo", "tipología"], "year": ["curso", "curs", "año"], "term": ["cuatrimestre", "semestre", "periodo", "temporalidad"],
}
# How the rest of a name that was cut in two begins; credits that a course may have.
FRAGMENT_STARTS = ["la ", "el ", "los ", "las ", "de ", "del ", "para ", "en ", "y ", "a ", "con ", "sobre ", "por "]
COURSE_CREDITS = [1, 1.5, 2, 3, 4, 4.5, 5, 6, 7.5, 8, 9, 10, 12, 14, 15, 18, 20, 24, 30]
# Patterns of what stands in the place of a course name but is none, and whole words of that sort.
NO_COURSE_NAME = [
    r"^(decreto|orden|bocm|boe|decreto-ley|ley|real decreto|resolución|ordenatorio)\b", r"^(?:(?:FB|OB|OP|PE|TFG|TFM|B|O)\s*)+$",
    r"^(?:n[º°\.]*\s*ctos|n[º°\.]*\s*cr[eé]ditos|c[oó]digo|ects|car[aá]cter|curso|cuatrimestre|semestre)\b",
    r"^(anexo|plan de estudios|bolet[ií]n oficial|ministerio|universidad|cve:|http|p[aá]gina|total\s+cr[eé]ditos|resumen|estructura general|distribuci[oó]n|observaciones)\b",
    r"^(?:grado|graduado|graduada|máster|master|doctorado|programa\s+(?:oficial\s+)?de\s+doctorado|enseñanza)\b",
    r"^(?:centros?\s+(?:propios|adscritos|integrados|universitarios)|campus\s+de|sede\s+de|facultad\s+de|escuela\s+de)\b",
    r"^(el rector|la rectora|el secretario general|la secretaria general|por delegaci[oó]n|el decano|la decana|el director|la directora|ante m[ií]|doy fe|firmado|visto bueno|v\.º\s*b\.º)\b",
]
NO_COURSE_WORD = ["asignatura", "carácter", "caracter", "créditos", "creditos", "curso", "materia", "módulo", "modulo", "ects", "tipo", "total", "grau", "màster", "master", "mencion", "mención"]
# Labels of sums of credits.
SUMMARY_LABEL = r"^(?:formaci[oó]n\s+b[aá]sica|b[aá]sic[ao]s?|obligatori[ao]s?|optativ[ao]s?|cr[eé]ditos\s+(?:b[aá]sicos|obligatorios|optativos)|materias\s+(?:b[aá]sicas|obligatorias|optativas)|asignaturas\s+(?:b[aá]sicas|obligatorias|optativas)|cr[eé]ditos\s+totales|total\s+(?:de\s+)?cr[eé]ditos|total|reconocimiento\s+(?:de\s+)?cr[eé]ditos|actividades\s+art[ií]culo\s+12\.8.*|pr[aá]cticas\s+acad[eé]micas\s+externas\s+optativas)\s*(?:\([a-z0-9\s]+\))?$"

# Headings of the degrees in a document that publishes several; openings that are no heading; ends of a preamble.
SECTION_MARKERS = [
    r"(?:ANEXO\s+[I|V|X\d]+|ANEXO\b)\s*[:\.\-–—]?\s*([^\n\r\(\)]+(?:\n[^\n\r\(\)]+)?)",
    r"(?:plan de estudios (?:conducentes?\s+)?(?:a\s+la\s+obtenci[oó]n\s+)?(?:del|al)\s+t[ií]tulo\s+(?:oficial\s+)?de\s*:?|(?:el\s+)?t[ií]tulo\s+(?:oficial\s+)?de\s*:?|denominaci[oó]n\s+del\s+t[ií]tulo\s*:?)\s*([^\n\r\(\)]+(?:\n[^\n\r\(\)]+)?)",
    r"(?:^|\n)\s*(?:\d+[\.\)]\s*)?(?:Plan de Estudios por Asignaturas\s*:\s*)?(?:(?:El\s+)?T[ií]tulo\s+de\s+)?(?:Grado|Graduado(?:\s*[\/\(]a[\/\)]|\s+o\s+Graduada)?|Graduada|M[aá]ster(?:\s+Universitario)?|Master|Doctorado|Bachelor|Grau)\s+(?:en|in|de|d'|del)\s+([A-ZÁÉÍÓÚÑ][^\n\r\(\)]{3,80}(?:\n[^\n\r\(\)]{3,80})?)",
]
PREAMBLE = r"^(?:resoluci[oó]n|acuerdo|orden|decreto|de\s+conformidad|visto\s+el)\b"
SIGNATURE = r"(?:El Rector|La Rectora|El Secretario General|La Secretaria General|El Director|La Directora)\b"
# Words that say nothing about a degree.
STOP_WORDS = [
    "el", "la", "los", "las", "un", "una", "unos", "unas",
    "de", "del", "en", "a", "al", "por", "con", "sin", "sobre", "para", "entre", "hacia", "desde", "hasta", "segun", "tras", "durante", "mediante",
    "y", "e", "o", "u", "ni", "que", "como", "donde", "cuando",
    "graduado", "graduada", "graduados", "graduadas", "grado", "grados",
    "master", "masteres", "máster", "másteres",
    "doctor", "doctora", "doctorado", "doctorados",
    "titulo", "titulos", "titulacion", "titulaciones", "título", "títulos", "titulación", "titulaciones",
    "estudio", "estudios", "plan", "planes", "oficial", "oficiales",
    "universidad", "universidades", "universitaria", "universitarias", "universitario", "universitarios",
    "conducente", "conducentes", "obtencion", "obtención", "superacion", "superación",
    "anexo", "anexos", "resolucion", "resolución", "decreto", "orden", "acuerdo",
    "centro", "centros", "facultad", "facultades", "escuela", "escuelas",
    "programa", "programas", "ensenanzas", "enseñanzas", "ensenanza", "enseñanza",
    "rama", "ramas", "conocimiento", "conocimientos", "mencion", "mención", "menciones",
    "distribucion", "distribución", "creditos", "créditos", "resumen", "estructura",
    "apartado", "materia", "materias", "asignatura", "asignaturas", "modulo", "módulo",
    "docon", "rector", "rectora", "secretario", "secretaria", "emilio", "lora", "tamayo",
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
    "bachelor", "bachelors", "master", "masters", "doctor", "phd", "degree", "degrees",
    "and", "in", "of", "for", "with", "the", "an", "science", "sciences",
    "engineering", "studies", "study", "university", "business", "management", "international",
    "applied", "advanced", "official", "curriculum", "syllabus",
    "grau", "graus", "estudis", "estudi", "pla", "plans", "oficial", "oficials",
    "universitat", "universitats", "universitari", "universitaris", "universitaria", "universitaries",
    "ciencies", "ciències", "socials", "juridiques", "jurídiques", "humanitats", "enginyeria", "enginyeries", "dels", "deles", "dela", "per", "amb",
    "grao", "graos", "estudos", "estudo", "plano", "planos", "universidade", "gradua", "graduak", "masterra", "unibertsitatea",
]

# Words of a table of marks, and of a table of courses, in five languages.
MARKS_TABLE = ["calificación cualitativa", "calificacion cualitativa", "calificación numérica", "calificacion numerica", "calificación estándar", "calificacion estandar", "escala de calificaciones", "tabla de equivalencias", "buscar por...", "1º apellido", "2º apellido", "qualificació qualitativa", "qualificacio qualitativa", "qualificació numèrica", "qualificacio numerica", "escala de qualificacions", "taula d'equivalències", "taula dequivalencies", "cerca per", "cualificación cualitativa", "cualificacion cualitativa", "táboa de equivalencias", "taboa de equivalencias", "kalifikazio kualitatiboa", "kalifikazio numerikoa", "bilatu", "grading scale", "qualitative grade", "numerical grade", "credit recognition"]
COURSE_TABLE = ["asignatura", "materia", "denominaci", "ects", "crédito", "credito", "carácter", "caracter", "semestre", "cuatrimestre", "guía docente", "guia docente", "assignatura", "credits", "curs", "tipus", "quadrimestre", "guia docent", "asineira", "creditos", "cuadrimestre", "irakasgaia", "kredituak", "maila", "ikasturtea", "mota", "lauhilekoa", "subject", "course", "module", "credits", "syllabus", "semester"]

# Words of addresses that lead to studies.
STUDY_ADDRESS = [
    "grado", "grados", "máster", "másteres", "master", "masteres", "doctorado", "doctorados", "titulación", "titulaciones", "estudio", "estudios", "enseñanza", "enseñanzas", "oferta-academica", "oferta_academica", "oferta-formativa",
    "plan-de-estudios", "plan_estudios", "plan-estudios", "planes-de-estudio", "guia-docente", "guias-docentes", "asignaturas", "programas", "curriculo", "currículo", "pensum", "malla-curricular", "titulos-oficiales", "estudios-oficiales",
    "grau", "graus", "graus-i-dobles-graus", "dobles-graus", "estudis-de-grau", "pla-destudis", "pla-estudis", "plans-destudi", "assignatures", "guia-docent", "guies-docents", "titulacions-oficials", "doctorat", "programes-de-doctorat",
    "grao", "graos", "graos-e-dobres-graos", "estudos-de-grao", "estudos", "plano-de-estudos", "posgrao", "doutoramento", "programas-de-doutoramento",
    "gradua", "graduak", "gradu-bikoitzak", "ikasketak", "ikasketa-plana", "irakasgaiak", "irakaskuntza", "eskaintza-akademikoa", "masterra", "masterrak", "unibertsitate-masterra", "graduondokoa", "doktoregoa", "doktorego-programak",
    "bachelor", "bachelors", "undergraduate", "degrees", "double-degrees", "study-plan", "study-plans", "curriculum", "syllabus", "courses", "subjects", "postgraduate", "graduate", "master-degrees", "phd", "doctorate", "doctoral-programmes",
]
# Words of titles by which no address is known.
COMMON_TITLE_WORDS = ["grado", "graduada", "graduado", "master", "máster", "universidad", "estudios", "oficial", "titulacion", "titulación"]
# Names of the registry's columns, also as they look in a wrong encoding.
REGISTRY_COLUMNS = {
    "codigo": ["Código", "CÃ³digo"], "universidad": ["Universidad"], "tipo": ["Tipo"], "comunidad": ["Comunidad Autónoma", "Comunidad AutÃ³noma"], "url": ["URL"], "municipio": ["Municipio"], "provincia": ["Provincia"],
    "email": ["EMail"], "telefono": ["Teléfono 1", "TelÃ©fono 1"], "titulo": ["Título", "TÃ\xadtulo"], "nivel": ["Nivel académico", "Nivel acadÃ©mico"],
    "estado": ["Estado", "Estado del título", "Estado del tÃ\xadtulo", "Estado del estudio", "Situación", "SituaciÃ³n"],
}

# Words that keep a line of running text from being a course; the form of such a line; credits it may have.
NO_COURSE_LINE = ["asignatura", "materia", "denominación", "carácter", "créditos", "ects", "curso", "página", "boletín"]
COURSE_LINE = r"^([A-ZÁÉÍÓÚÑa-záéíóúñ0-9\s\-\,\.\(\)]{5,70})\s+(\d+(?:[\.,]\d+)?)\s+(FB|OB|OP|PE|TFG|TFM|Obligatoria|Optativa|Básica)\b"
LINE_CREDITS = [1, 1.5, 2, 3, 4, 4.5, 5, 6, 7.5, 8, 9, 10, 12, 14, 15, 18]
# Words of header rows on web pages, what their cells stand for (in this order), words that no course name holds, and years.
WEB_HEADER = ["asignatura", "materia", "nombre", "crédito", "credito", "ects", "curso", "carácter", "caracter", "tipo", "código", "codigo", "guía", "guia", "semestre", "cuatrimestre", "assignatura", "credits", "curs", "tipus", "quadrimestre", "guia docent", "asineira", "creditos", "cuadrimestre", "irakasgaia", "kredituak", "maila", "ikasturtea", "mota", "lauhilekoa", "subject", "course", "module", "credits", "type", "year", "semester", "term", "syllabus"]
WEB_ROLES = {
    "subject": ["asignatura", "assignatura", "asineira", "irakasgaia", "materia", "denominaci", "nombre", "actividad", "subject", "course", "modul", "módulo", "modulo"], "ects": ["crédito", "credito", "crèdit", "credit", "kreditu", "ects"],
    "kind": ["carácter", "caracter", "caràcter", "tipo", "tipus", "mota", "type"], "year": ["curso", "curs", "ano", "año", "ikasturtea", "maila", "year", "level"],
}
WEB_YEARS = ["1º", "2º", "3º", "4º", "primer", "segundo", "tercer", "cuarto", "1er", "2do", "3er", "4to"]
NO_WEB_COURSE = [
    "lunes", "martes", "miércoles", "miercoles", "jueves", "viernes", "sábado", "sabado", "dilluns", "dimarts", "dimecres", "dijous", "divendres", "dissabte", "luns", "mércores", "venres",
    "astelehena", "asteartea", "asteazkena", "osteguna", "ostirala", "larunbata", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "aula magna", "aula virtual", "número de aula", "numero de aula", "despacho", "horario de clases", "horari de classes", "timetable", "schedule", "calendario de exámenes", "calendari d'exàmens", "egutegia", "convocatoria ordinaria", "convocatoria extraordinaria",
    "suspenso", "aprobado", "notable", "sobresaliente", "matrícula de honor", "matricula de honor", "calificación cualitativa", "calificacion cualitativa", "calificación numérica", "calificacion numerica", "calificación estándar", "calificacion estandar", "escala de calificaciones", "tabla de equivalencias",
    "baremo", "convalidación", "convalidacion", "reconocimiento de créditos", "reconocimiento de creditos", "suspes", "suspès", "aprovat", "excel·lent", "matricula d'honor", "matricula de honor", "qualificació qualitativa", "qualificacio qualitativa", "qualificació numèrica", "qualificacio numerica",
    "escala de qualificacions", "taula d'equivalències", "taula dequivalencies", "reconeixement de crèdits", "reconeixement de credits", "sobresalinte", "cualificación cualitativa", "cualificacion cualitativa", "táboa de equivalencias", "taboa de equivalencias", "recoñecemento de créditos",
    "ez-gai", "oso ondo", "bikain", "ohorezko matrikula", "kalifikazio kualitatiboa", "kalifikazio numerikoa", "kreditu-aitorpena", "grading scale", "qualitative grade", "numerical grade", "credit recognition", "buscar por", "1º apellido", "2º apellido", "listado simple", "listado detallado", "cerca per", "bilatu",
]

# Words by which no link names a degree.
LINK_STOP_WORDS = [
    "grado", "grados", "máster", "másteres", "master", "masteres", "doctorado", "doctorados",
    "universitario", "oficial", "sobre", "entre", "para", "como", "esta", "este", "estos", "estas",
    "del", "los", "las", "por", "con", "una", "uno", "que", "sus", "mas", "más",
    "en", "the", "and", "for", "of", "in", "to", "i", "de", "a", "el", "la", "l'", "d'", "els", "les", "o", "u",
]
# Signs on a degree's page that it has ended.
ENDED = [
    "extinguid", "extincion", "extinta", "extinto", "sin docencia", "baja", "derogad", "cancelad", "eliminad", "revocad", "suspendid", "caducad",
    "desestimad", "sustituid", "no impartid", "sin efecto", "cierre", "cerrad", "archivo", "rd 56/2005",
]

# What a price is founded on.
PRICE_SOURCE = {"private": "Universidad Privada (Tarifas fijadas por la institución)", "unknown": "CCAA desconocida o no registrada (%s)", "official": "Oficial SIIU / "}
