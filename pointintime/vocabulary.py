"""Closed vocabularies and limits."""

# Spellings, names and limits that results depend on.
PARTICIPATION = {
    "FULL": "FULL",
    "FP": "FULL",
    "FULL PARTICIPATION": "FULL",
    "LIMITED": "LIMITED",
    "LP": "LIMITED",
    "LIMITED PARTICIPATION": "LIMITED",
    "DNP": "DNP",
    "DID NOT PARTICIPATE": "DNP",
}
GAME_STATUS_SPELLINGS = ("OUT", "DOUBTFUL", "QUESTIONABLE", "QUES", "Q", "D", "O")
GAME_STATUSES = ("OUT", "DOUBTFUL", "QUESTIONABLE")
PRACTICE_STATUSES = ("DNP", "LIMITED", "FULL")
REPORT_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
GROUP_LABELS = ("Out", "Doubtful", "Questionable", "Did Not Participate", "Limited Participation", "Full Participation", "DNP", "LP", "FP")
TABULAR_KINDS = ("injury_report", "depth_chart", "inactives", "gamebook")
NULL_SPELLINGS = ("null", "none", "n/a", "-", "(-)")
REPORT_COLUMNS = ("Team", "Day", "Pos", "Player", "Injury", "Practice", "Status")
PUBLISHED_META_KEYS = ("article:published_time", "og:published_time", "datePublished", "pubdate")
CLUBS = (
    ("ARI", "Cardinals", "www.azcardinals.com"),
    ("ATL", "Falcons", "www.atlantafalcons.com"),
    ("BAL", "Ravens", "www.baltimoreravens.com"),
    ("BUF", "Bills", "www.buffalobills.com"),
    ("CAR", "Panthers", "www.panthers.com"),
    ("CHI", "Bears", "www.chicagobears.com"),
    ("CIN", "Bengals", "www.bengals.com"),
    ("CLE", "Browns", "www.clevelandbrowns.com"),
    ("DAL", "Cowboys", "www.dallascowboys.com"),
    ("DEN", "Broncos", "www.denverbroncos.com"),
    ("DET", "Lions", "www.detroitlions.com"),
    ("GB", "Packers", "www.packers.com"),
    ("HOU", "Texans", "www.houstontexans.com"),
    ("IND", "Colts", "www.colts.com"),
    ("JAX", "Jaguars", "www.jaguars.com"),
    ("KC", "Chiefs", "www.chiefs.com"),
    ("LA", "Rams", "www.therams.com"),
    ("LAC", "Chargers", "www.chargers.com"),
    ("LV", "Raiders", "www.raiders.com"),
    ("MIA", "Dolphins", "www.miamidolphins.com"),
    ("MIN", "Vikings", "www.vikings.com"),
    ("NE", "Patriots", "www.patriots.com"),
    ("NO", "Saints", "www.neworleanssaints.com"),
    ("NYG", "Giants", "www.giants.com"),
    ("NYJ", "Jets", "www.newyorkjets.com"),
    ("PHI", "Eagles", "www.philadelphiaeagles.com"),
    ("PIT", "Steelers", "www.steelers.com"),
    ("SEA", "Seahawks", "www.seahawks.com"),
    ("SF", "49ers", "www.49ers.com"),
    ("TB", "Buccaneers", "www.buccaneers.com"),
    ("TEN", "Titans", "www.tennesseetitans.com"),
    ("WAS", "Commanders", "www.commanders.com"),
)
#: (club, kind) pairs that have no page to poll, and why.
UNAVAILABLE = {("DAL", "transactions"): "no such page", ("DET", "injury_index"): "HTTP 404 for this client"}
INDEX_CADENCE_SECONDS = 6 * 60 * 60
STALENESS_MULTIPLE = 2
WINDOW_CHARS, OVERLAP_CHARS = 1200, 200
MAX_PLAYER_NAME, MAX_INJURY = 128, 64
RRF_K = 60
CANDIDATES, TOP_K = 50, 10
EXTRACTOR_VERSION = "v2"
COST_INPUT_TOKENS, COST_OUTPUT_TOKENS, COST_INPUT_USD, COST_OUTPUT_USD = 600, 200, 1.0, 5.0
RATE_WINDOW_SECONDS, RATE_LIMIT = 60, 30
ARTICLES_PER_PASS, LINKS_PER_PAGE = 25, 200
EXTRACT_CHUNKS_PER_RUN, CHUNK_DOCUMENTS_PER_RUN = 50, 500

# The suffixes of the published English stemming rules, and the words that the English text search configuration leaves out.
STEM_DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEM_SHORTENED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEM_DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())
#: The default weight of a term's position, the sum of 1/n**2 over all n, and positions that count for one term and in one text.
RANK_WEIGHT, RANK_LIMIT, RANK_POSITIONS, LAST_POSITION = 0.1, 1.64493406685, 255, 16_383

# Patterns that results depend on, of positions and names in report lines, headings, display dates, report links.
POSITION_PATTERN = r"[A-Z]{1,3}(?:/[A-Z]{1,3})?"
NAME_PATTERN = r"[A-Z0-9][\p{L}\p{N}_'’.\-]*(?:\s+[A-Z0-9][\p{L}\p{N}_'’.\-]*){0,3}"
DETAIL_PATTERN = r"\(([^)]*)\)"
DAY_HEADING_TAIL = r"['’]?s?\s+(?:Injury|Practice)\s+Report"
TEAM_HEADING_PATTERN = r"(?i)(?:Injury|Practice|Game\s+Status)\s+Report"
REPORT_GATE_PATTERN, REPORT_GATE_CHARS = "(?i)injury report|practice report", 4000
HEADING_CHARS, BARE_LINE_CHARS = 120, 48
DISPLAY_DATE_PATTERN = r"\b([A-Z][a-z]{2})\s+(\d{1,2}),\s+(\d{4})(?:\s+at\s+(\d{1,2}):(\d{2})\s*([AP]M))?"
LINK_TITLE_PATTERN = r"(?i)\b(?:injury\s+report|inactives|practice\s+report|game\s+status|roster\s+moves?)"
SKIPPED_PATH_PATTERN = r"(?i)/(?:video|photos|audio|podcast|team)/"
