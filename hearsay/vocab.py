"""Word lists, patterns and codes that results depend on.

A brand's own name is never listed here; callers pass it in.
"""

# Fixed value: the 31 marks removed before matching, in their natural order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_{|}~"

# Placeholders left in the log for content that is gone, and the bot author.
REMOVED = "[removed]"
DELETED = "[deleted]"
BOT_AUTHOR = "AutoModerator"

# Sentiment labels and their ordinal codes.
SENTIMENT_CODES = {"negative": 0, "neutral": 1, "positive": 2}

# Spark's default English stop words.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the
and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

# Words dropped from top-word tables on top of the stop words.
TOP_WORD_NOISE = [
    "•", "sure", "also", "thing", "it", "one", "", "please", "get", "it's", "i'm", "think",
    "im", "make", "much", "20",
]

# Words dropped before topic modelling on top of the stop words.
TOPIC_NOISE = """
from subject re bot please like questions moderators subreddit edu use automatically names
sidebar rules message performed compose welcome action include sure within deleted list much
minutes complete
""".split()

# General product categories counted per brand. The per-brand
# sentiment table uses the first twenty-five.
PRODUCT_CATEGORIES = """
lipstick eyeshadow blush bronzer mascara foundation concealer gloss eyeliner gel powder
moisturizer sunscreen shampoo conditioner hairspray palette perfume brush oil serum cream soap
cleanser makeup hair skincare mask sponge
""".split()

# Product names looked up as a whole text or a whole word.
PRODUCT_VOCABULARY = [
    "bdc", "lashslick", "wowder", "concealer", "mascara", "highlighter", "candle", "rollerball",
    "balm dot com", "balm dotcom", "hoodie", "tote", "sweatshirt", "boybrow", "brow gel",
    "generation g", "scarf", "clip", "clips", "hair clips", "perfume", "cloud paint",
    "cloudpaint", "blush", "eyeliner", "no.1 pencil", "no. 1 pencil", "skin tint",
    "stretch concealer", "pomade", "lipstick", "pisces", "lash slick", "brush", "eyeshadow",
    "pro tip", "protip", "solar paint", "bronzer", "solarpaint", "monochromes", "milky oil",
    "brow flick", "browflick", "haloscope", "lipgloss", "lip gloss", "lidstar", "ls",
    "swiss miss", "le", "sticker", "comb", "kit", "body hero", "futuredew",
    "milk jelly cleanser", "cleanser", "jelly cleanser", "after baume", "after balm",
    "moisturizer", "priming moisturizer", "retinol", "pro-retinol", "universal pro-retinol",
    "sunscreen", "zit", "zit sticker", "zitsticker", "tin", "tins", "cranberry", "cordial",
    "olivia rodrigo",
]

# Nickname -> product, in the order the chain applies them.
RENAME_RULES = [
    ("bdc", "tinted chapstick"), ("balm dot com", "tinted chapstick"),
    ("balm dotcom", "tinted chapstick"), ("balm", "tinted chapstick"),
    ("swiss miss", "tinted chapstick"), ("cloudpaint", "blush"), ("cloud paint", "blush"),
    ("pisces", "lipstick"), ("ls", "mascara"), ("lash slick", "mascara"),
    ("lashslick", "mascara"), ("browflick", "brow pencil"), ("brow flick", "brow pencil"),
    ("flick", "brow pencil"), ("wowder", "face powder"), ("rollerball", "perfume"),
    ("boy brow", "brow gel"), ("boybrow", "brow gel"), ("pomade", "brow gel"),
    ("generation g", "lipstick"), ("gen g", "lipstick"), ("pisces", "lipstick"),
    ("clips", "merch"), ("clip", "merch"), ("hoodie", "merch"), ("sweatshirt", "merch"),
    ("tote", "merch"), ("no.1 pencil", "eyeliner"), ("no. 1 pencil", "eyeliner"),
    ("pencil", "eyeliner"), ("skin tint", "foundation"), ("stretch concealer", "concealer"),
    ("stretchconcealer", "concealer"), ("protip", "eyeliner"), ("solarpaint", "bronzer"),
    ("solar paint", "bronzer"), ("pro tip", "eyeliner"), ("monochromes", "eyeshadow"),
    ("milky oil", "skincare"), ("oil", "skincare"), ("serum", "skincare"),
    ("haloscope", "highlighter"), ("lip gloss", "lipgloss"), ("lidstar", "eyeshadow"),
    ("futuredew", "skincare"), ("milk jelly cleanser", "skincare"), ("cleanser", "skincare"),
    ("jelly", "skincare"), ("zit sticker", "skincare"), ("zitsticker", "skincare"),
    ("zit", "skincare"), ("after baume", "sunscreen"), ("after balm", "sunscreen"),
    ("cranberry", "limited edition products"), ("cordial", "limited edition products"),
    ("olivia rodrigo", "limited edition products"), ("priming moisturize", "skincare"),
    ("moisturizer", "skincare"), ("pro-retinol", "skincare"), ("retinol", "skincare"),
]

# The chain has no working rule for the two-letter nickname; whole-word matching can have one.
WHOLE_WORD_RULES = RENAME_RULES + [("le", "limited edition products")]

# Product -> spellings, for the product-by-sentiment table.
PRODUCT_SPELLINGS = {
    "bdc": ["bdc"], "lashslick": ["lashslick"], "powder": ["powder"],
    "concealer": ["concealer"], "mascara": ["mascara"], "highlighter": ["highlighter"],
    "candle": ["candle"], "rollerball": ["rollerball"],
    "balm_dot_com": ["balm dot com", "balm dotcom"], "hoodie": ["hoodie"], "tote": ["tote"],
    "boybrow": ["boybrow"], "brow_gel": ["brow gel"], "generation_g": ["generation g"],
    "scarf": ["scarf"], "clip": ["clip", "clips"], "hair_clips": ["hair clips"],
    "perfume": ["perfume"], "cloud_paint": ["cloud paint", "cloudpaint"], "blush": ["blush"],
    "eyeliner": ["eyeliner"], "pencil": ["no. 1 pencil", "no.1 pencil"],
    "skin_tint": ["skin tint"], "stretch_concealer": ["stretch concealer"],
    "pomade": ["pomade"], "lipstick": ["lipstick"], "lash_slick": ["lash slick"],
    "brush": ["brush"], "eyeshadow": ["eyeshadow"], "protip": ["pro tip", "protip"],
    "solar_paint": ["solar paint", "solarpaint"], "bronzer": ["bronzer"],
    "monochromes": ["monochromes"], "milky_oil": ["milky oil"],
    "brow_flick": ["brow flick", "browflick"], "haloscope": ["haloscope"],
    "lidstar": ["lidstar", "ls"], "swiss_miss": ["swiss miss"], "le": ["le"],
    "sticker": ["sticker"], "comb": ["comb"], "kit": ["kit"], "body_hero": ["body hero"],
    "futuredew": ["futuredew"], "cleanser": ["cleanser", "milk jelly cleanser", "jelly cleanser"],
    "after_balm": ["after baume", "after balm"],
    "moisturizer": ["moisturizer", "priming moisturizer"],
    "retinol": ["retinol", "pro-retinol", "universal pro-retinol"],
    "sunscreen": ["sunscreen"], "zit": ["zit", "zit sticker", "zitsticker"],
    "tin": ["tin", "tins"], "cranberry": ["cranberry"], "cordial": ["cordial"],
    "olivia_rodrigo": ["olivia rodrigo"],
}

# Places looked for in location texts.
PLACES = [
    "stockholm", "san francisco", "seattle", "london", "brooklyn", "oslo", "boston",
    "philadelphia", "minneapolis", "wolverhampton", "kent", "indianapolis", "paris", "miami",
    "atlanta", "new york", "houston", "los angeles", "chicago", "toronto", "washington dc",
    "charleston", "bordeaux", "austin", "melbourne", "madre linda", "dublin", "dartford",
    "vancouver", "dallas", "san juan", "copenhagen", "portland", "buenos aires", "cape may",
    "denver", "selangor", "ipoh", "san diego", "stirling", "leeds", "phoenix", "tucson",
    "gothenburg", "st. louis", "greenwich", "suzhou", "montreal", "nashville", "new orleans",
    "savannah", "pittsburgh", "honolulu", "hong kong", "albuquerque", "oxford", "edinburgh",
    "asbury park", "charlotte", "orlando", "cincinnati", "oakland", "san jose", "quebec",
    "lake worth", "midlands", "canyon lake", "salt lake city", "baltimore",
]

# Columns dropped from the comment and the post tables.
COMMENT_DROPS = """
author_cakeday author_flair_css_class author_flair_text permalink stickied gilded distinguished
can_gild retrieved_on edited
""".split()
POST_DROPS = """
whitelist_status url thumbnail_width thumbnail_height thumbnail third_party_tracking_2
third_party_tracking third_party_trackers suggested_sort secure_media_embed retrieved_on
promoted_url parent_whitelist_status link_flair_text link_flair_css_class imp_pixel href_url
gilded embed_url author_flair_css_class author_cakeday adserver_imp_pixel adserver_click_url
secure_media post_hint permalink original_link mobile_ad_url embed_type domain_override domain
author preview author_flair_text edited crosspost_parent_list media media_embed
""".split()
