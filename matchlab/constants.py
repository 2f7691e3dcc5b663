"""Fixed values the results depend on, stated in one place.

Everything here is a plain value (number, word list, lookup, pattern).  Rules
that use them live in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --- fixed values: ratings -------------------------------------------------
INITIAL_RATING = 1500.0
HOME_ADVANTAGE = 100.0
RATING_SCALE = 400.0
INACTIVITY_DAYS = 365
INACTIVITY_RATE = 0.1
DRAW_BASE_RATE = 0.26
DRAW_RATING_SCALE = 200.0
DEFAULT_K = 35.0
COMPETITION_K = {
    "FIFA World Cup": 60.0,
    "UEFA Euro": 50.0,
    "Copa America": 50.0,
    "Africa Cup of Nations": 50.0,
    "AFC Asian Cup": 50.0,
    "CONCACAF Gold Cup": 40.0,
    "FIFA World Cup qualification": 40.0,
    "UEFA Euro qualification": 40.0,
    "Friendly": 20.0,
}

# --- fixed values: context -------------------------------------------------
FRIENDLY = "Friendly"
FRIENDLY_WEIGHT = 0.2
RECENCY_HALF_LIFE_DAYS = 1095.0
CURRENT_BOOST = 1.0
CURRENT_TOURNAMENT = "FIFA World Cup"
CURRENT_START = "2026-06-01"
CURRENT_FIRST_MATCH = "2026-06-11"
CURRENT_KNOCKOUT_START = "2026-06-28"
CURRENT_YEAR = 2026
CURRENT_COUNTRY = "United States"
MAJOR_TOURNAMENTS = (
    "FIFA World Cup",
    "UEFA Euro",
    "Copa America",
    "Africa Cup of Nations",
    "AFC Asian Cup",
    "CONCACAF Gold Cup",
)
HOSTS = ("United States", "Canada", "Mexico")
UPCOMING_REST_DAYS = 7.0
SQUAD_TOURNAMENTS = (
    ("FIFA World Cup", 2026, "wc2026"),
    ("FIFA World Cup", 2022, "wc2022"),
    ("FIFA World Cup", 2018, "wc2018"),
    ("FIFA World Cup", 2014, "wc2014"),
    ("UEFA Euro", 2024, "euro2024"),
    ("UEFA Euro", 2021, "euro2021"),
    ("UEFA Euro", 2016, "euro2016"),
)
TOP_LEAGUES = ("Premier League", "La Liga", "Bundesliga", "Serie A", "Ligue 1")
TOP_LEAGUE_CLUBS = (
    # England
    "Arsenal", "Aston Villa", "Bournemouth", "Brentford", "Brighton",
    "Brighton & Hove Albion", "Chelsea", "Crystal Palace", "Everton", "Fulham",
    "Ipswich Town", "Ipswich", "Leicester City", "Leicester", "Liverpool",
    "Manchester City", "Man City", "Manchester United", "Man Utd", "Man United",
    "Newcastle United", "Newcastle", "Nottingham Forest", "Southampton",
    "Tottenham Hotspur", "Tottenham", "Spurs", "West Ham United", "West Ham",
    "Wolverhampton Wanderers", "Wolves",
    # Spain
    "Athletic Club", "Athletic Bilbao", "Atletico Madrid", "Atlético Madrid",
    "Atl. Madrid", "Barcelona", "Celta Vigo", "Celta", "Deportivo Alaves",
    "Alavés", "Alaves", "Espanyol", "Getafe", "Girona", "Las Palmas", "Leganes",
    "Leganés", "Mallorca", "Osasuna", "Rayo Vallecano", "Rayo", "Real Betis",
    "Betis", "Real Madrid", "Real Sociedad", "Real Valladolid", "Valladolid",
    "Sevilla", "Valencia", "Villarreal",
    # Germany
    "Augsburg", "FC Augsburg", "Bayer Leverkusen", "Leverkusen", "Bayern Munich",
    "FC Bayern Munich", "Bayern", "Borussia Dortmund", "Dortmund", "BVB",
    "Borussia Monchengladbach", "Borussia M'gladbach",
    "Borussia Mönchengladbach", "Monchengladbach", "Eintracht Frankfurt",
    "Frankfurt", "FC Heidenheim", "Heidenheim", "FC St. Pauli", "St. Pauli",
    "Freiburg", "SC Freiburg", "Hamburg", "Hamburger SV", "HSV",
    "Holstein Kiel", "Kiel", "Mainz", "FSV Mainz 05", "RB Leipzig", "Leipzig",
    "Stuttgart", "VfB Stuttgart", "Union Berlin", "1. FC Union Berlin",
    "VfL Bochum", "Bochum", "VfL Wolfsburg", "Wolfsburg", "Werder Bremen",
    "Bremen",
    # Italy
    "AC Milan", "Milan", "Atalanta", "Bologna", "Cagliari", "Como", "Empoli",
    "Fiorentina", "Genoa", "Hellas Verona", "Verona", "Inter Milan", "Inter",
    "Internazionale", "FC Internazionale", "Juventus", "Lazio", "SS Lazio",
    "Lecce", "Monza", "Napoli", "SSC Napoli", "Parma", "Roma", "AS Roma",
    "Torino", "Udinese", "Venezia",
    # France
    "Angers", "Auxerre", "AJ Auxerre", "Brest", "Stade Brestois", "Le Havre",
    "Lens", "RC Lens", "Lille", "LOSC Lille", "Lyon", "Olympique Lyonnais",
    "Marseille", "Olympique de Marseille", "Monaco", "AS Monaco", "Montpellier",
    "Nantes", "FC Nantes", "Nice", "OGC Nice", "PSG", "Paris Saint-Germain",
    "Paris SG", "Reims", "Stade de Reims", "Rennes", "Stade Rennais",
    "Saint-Etienne", "Saint-Étienne", "AS Saint-Étienne", "Strasbourg",
    "RC Strasbourg", "Toulouse", "TFC",
)

# --- fixed values: form ----------------------------------------------------
SEQUENCE_LENGTH = 10
AGGREGATE_LENGTH = 5
FORM_RATING_SCALE = 1500.0

# --- fixed values: score grid ----------------------------------------------
MAX_GOALS = 7
REGULATION_MINUTES = 90
LOG_FLOOR = 1e-10
RATE_FLOOR = 0.01

# --- fixed values: goal-rate models ----------------------------------------
DECAY_PER_DAY = 0.0065
RHO_BOUND = 0.99
TREE_REST_CAP = 365.0
TREE_COUNT = 300
TREE_DEPTH = 4
TREE_STEP = 0.05
TREE_SUBSAMPLE = 0.8
TREE_SEED = 42
UNFITTED_HOME_MEAN = 1.5
UNFITTED_AWAY_MEAN = 1.1

# --- fixed values: adjustments ---------------------------------------------
INJURY_K = 0.5
NAME_MATCH_CUTOFF = 0.80
SENTIMENT_K = 0.30
SENTIMENT_RANGE = (0.70, 1.30)
TRAJECTORY_K = 0.15
TRAJECTORY_RANGE = (0.85, 1.15)
MIN_CONFIDENCE = 0.25

# --- fixed values: bets and back-tests -------------------------------------
KELLY_FRACTION = 0.25
MIN_EDGE = 0.02
MIN_MARKET_PROB = 0.08
MIN_RELATIVE_EDGE = 0.20
FIRST_TRAIN_MONTHS = 36
VALIDATION_MONTHS = 6
STEP_MONTHS = 6
CALIBRATION_BINS = 10
SMALL_BIN = 5
TEMPERATURE_RANGE = (0.01, 10.0)

# --- fixed values: feeds ---------------------------------------------------
FINISHED_STATUSES = ("FT", "AET", "PEN")
ABSENCE_TYPES = ("Injury", "Suspension")
ODDS_FRESH_MINUTES = 15
NOTICE_MINUTES = 60
NEXT_WINDOW_MINUTES = 30
PLACEHOLDER_PATTERN = r"^([0-9][A-Z]|[WL][0-9]+|[0-9][A-Z](/[A-Z])+)$"
PLACEHOLDER_WORDS = (
    "winner", "runner-up", "runner up", "3rd", "third", "loser", "tbd",
    "to be determined",
)
KICKOFF_PATTERN = r"^([0-9]{1,2}):([0-9]{2})\s*UTC([+-][0-9]+)$"
POSITIONS = {
    "gk": "GK", "goalkeeper": "GK", "g": "GK",
    "df": "DF", "defender": "DF", "d": "DF", "cb": "DF", "lb": "DF", "rb": "DF",
    "mf": "MF", "midfielder": "MF", "m": "MF", "cm": "MF", "dm": "MF", "am": "MF",
    "fw": "FW", "forward": "FW", "f": "FW", "st": "FW", "cf": "FW", "ss": "FW",
    "lw": "FW", "rw": "FW", "wf": "FW",
}

# One alias map per feed; a name that is not listed stays as it is.
TEAM_ALIASES = {
    "nested": {
        "Korea Republic": "South Korea",
        "Republic of Korea": "South Korea",
        "IR Iran": "Iran",
        "Turkiye": "Turkey",
        "Türkiye": "Turkey",
        "Côte d'Ivoire": "Ivory Coast",
        "Cote d'Ivoire": "Ivory Coast",
        "DPR Korea": "North Korea",
        "Czechia": "Czech Republic",
        "Bosnia & Herzegovina": "Bosnia and Herzegovina",
        "Democratic Republic of Congo": "DR Congo",
        "Congo DR": "DR Congo",
        "USA": "United States",
        "Cape Verde Islands": "Cape Verde",
        "Curacao": "Curaçao",
    },
    "flat": {
        "USA": "United States",
        "Bosnia & Herzegovina": "Bosnia and Herzegovina",
    },
    "wiki": {
        "USA": "United States",
        "US": "United States",
        "Korea Republic": "South Korea",
        "Republic of Korea": "South Korea",
        "IR Iran": "Iran",
        "Islamic Republic of Iran": "Iran",
        "DPR Korea": "North Korea",
        "Côte d'Ivoire": "Ivory Coast",
        "Cote d'Ivoire": "Ivory Coast",
        "Türkiye": "Turkey",
        "Turkiye": "Turkey",
        "Czechia": "Czech Republic",
    },
    "odds": {
        "usa": "united states",
        "bosnia & herzegovina": "bosnia and herzegovina",
        "côte d'ivoire": "ivory coast",
        "cote d'ivoire": "ivory coast",
        "korea republic": "south korea",
        "ir iran": "iran",
        "turkiye": "turkey",
        "türkiye": "turkey",
        "democratic republic of congo": "dr congo",
        "czechia": "czech republic",
        "cape verde islands": "cape verde",
        "curacao": "curaçao",
    },
}

# --- fixed values: news ----------------------------------------------------
ARTICLE_MAX_CHARS = 8000
PARAGRAPH_MIN_CHARS = 60
BODY_MIN_CHARS = 150
FINGERPRINT_CHARS = 120
TEAM_ARTICLES = 6
MATCH_ARTICLES = 12
REPORT_WINDOW_DAYS = 2
BLOCK_SEPARATOR = "\n\n---\n\n"
BODY_DOMAINS = ("bbc.", "theguardian.com", "espn.com")
BOILERPLATE_WORDS = (
    "cookie", "subscribe", "close dialogue", "toggle caption",
    "document.addeventlistener", "veggieburger", "print subscriptions",
    "search jobs",
)
TRAJECTORY_VERSION = 4
SEARCH_TERMS = {
    "Argentina": ("Argentina", "Argentine"),
    "Australia": ("Australia", "Socceroos"),
    "Austria": ("Austria",),
    "Belgium": ("Belgium", "Belgian", "Red Devils"),
    "Bosnia and Herzegovina": ("Bosnia",),
    "Brazil": ("Brazil", "Seleção"),
    "Canada": ("Canada", "Canadian", "CanMNT", "Marsch", "Davies"),
    "Cape Verde": ("Cape Verde",),
    "Colombia": ("Colombia", "Colombian"),
    "Croatia": ("Croatia", "Croatian"),
    "Czech Republic": ("Czech", "Czechia"),
    "Curaçao": ("Curaçao", "Curacao"),
    "DR Congo": ("Congo", "DR Congo"),
    "Ecuador": ("Ecuador",),
    "Egypt": ("Egypt", "Egyptian", "Salah"),
    "England": ("England", "Tuchel", "Three Lions"),
    "France": ("France", "French", "Les Bleus"),
    "Germany": ("Germany", "German"),
    "Ghana": ("Ghana",),
    "Haiti": ("Haiti",),
    "Iran": ("Iran",),
    "Iraq": ("Iraq",),
    "Ivory Coast": ("Ivory Coast", "Côte d'Ivoire"),
    "Japan": ("Japan", "Samurai Blue"),
    "Jordan": ("Jordan",),
    "Mexico": ("Mexico", "Mexican", "El Tri"),
    "Morocco": ("Morocco", "Atlas Lions"),
    "Netherlands": ("Netherlands", "Dutch", "Holland"),
    "New Zealand": ("New Zealand", "All Whites"),
    "Norway": ("Norway", "Norwegian", "Haaland"),
    "Panama": ("Panama",),
    "Paraguay": ("Paraguay",),
    "Portugal": ("Portugal", "Ronaldo"),
    "Qatar": ("Qatar",),
    "Saudi Arabia": ("Saudi Arabia", "Saudi"),
    "Scotland": ("Scotland", "Scottish"),
    "Senegal": ("Senegal",),
    "South Africa": ("South Africa", "Bafana", "Broos", "Lyle Foster"),
    "South Korea": ("South Korea", "Korea"),
    "Spain": ("Spain", "Spanish", "La Roja"),
    "Sweden": ("Sweden", "Swedish"),
    "Switzerland": ("Switzerland", "Swiss"),
    "Tunisia": ("Tunisia",),
    "Turkey": ("Turkey", "Turkish", "Türkiye"),
    "United States": ("United States", "USA", "USMNT", "US men"),
    "Uruguay": ("Uruguay",),
    "Uzbekistan": ("Uzbekistan",),
}

# --- fixed values: recurrent score network ---------------------------------
EMBED_DIM = 32
GRU_HIDDEN = 32
FORM_FEATURES = 5
CONTEXT_DIM = 13
CONTEXT_HIDDEN = 32
CONTEXT_OUT = 16
FUSION_HIDDEN = 64
RHO_SCALE = 0.2
REST_SCALE = 180.0
