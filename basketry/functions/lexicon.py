"""Default word lists of the grocery domain.

Every operator takes its word lists as parameters; these are the defaults.
"""

from __future__ import annotations

# Results depend on exactly these words.
UNITS = (
    "tsp", "teaspoon", "teaspoons", "tbsp", "tablespoon", "tablespoons", "cup", "cups", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "g",
    "gram", "grams", "kg", "kilogram", "kilograms", "ml", "l", "liter", "liters", "pinch", "pinches", "dash", "dashes", "clove", "cloves", "can",
    "cans", "package", "packages", "pkg", "pkgs", "bunch", "bunches", "slice", "slices", "stick", "sticks", "piece", "pieces", "quart", "quarts",
    "pint", "pints", "sprig", "sprigs", "bag", "bags",
)

PREP_WORDS = (
    "chopped", "diced", "minced", "shredded", "grated", "sliced", "cubed", "peeled", "crushed", "freshly", "fresh", "softened", "melted", "room",
    "temperature", "large", "small", "medium", "extra", "virgin", "optional", "to", "taste", "thinly", "roughly", "finely", "halved", "divided",
    "boneless", "skinless", "trimmed", "cooked", "uncooked", "drained", "rinsed", "beaten", "packed", "frozen", "thawed", "lightly", "reduced",
    "sodium",
)

STOP_TOKENS = ("and", "or", "with", "of")

SYNONYMS = {
    "scallions": "green onions",
    "green onion": "green onions",
    "spring onions": "green onions",
    "confectioners sugar": "powdered sugar",
    "icing sugar": "powdered sugar",
    "caster sugar": "sugar",
    "bell peppers": "bell pepper",
    "tomatoes": "tomato",
    "potatoes": "potato",
    "new potatoes": "potato",
    "onions": "onion",
    "limes": "lime",
    "lemons": "lemon",
    "apples": "apple",
    "garlic cloves": "garlic",
    "chicken breasts": "chicken breast",
    "olive oil extra virgin": "olive oil",
    "evoo": "olive oil",
    "courgette": "zucchini",
    "aubergine": "eggplant",
    "coriander leaves": "cilantro",
    "italian loaf": "italian bread",
    "round italian loaf": "italian bread",
    "egg whites": "egg white",
    "hot apple cider": "apple cider",
    "chamomile tea bags": "chamomile tea",
    "aleppo pepper": "red pepper flakes",
    "moong dal": "lentils",
    "masoor dal": "red lentils",
    "urad dal": "lentils",
    "assorted dals": "lentils",
    "thai chiles": "green chiles",
    "thai chile": "green chiles",
}

SPIRIT_SYNONYMS = {
    "scotch": "whiskey",
    "mezcal": "tequila",
    "mescal": "tequila",
    "amontillado": "sherry",
    "oloroso": "sherry",
    "reposado": "tequila",
    "blanco": "tequila",
    "anejo": "tequila",
}

SKIP_EXACT = ("divided", "melted", "plus more", "room temperature", "for finishing", "for serving", "to taste", "optional", "hot water", "warm water",
    "cold water", "water")

SKIP_PHRASES = (
    "plus more",
    "for finishing",
    "for serving",
    "to taste",
    "room temperature",
    "stems removed",
    "cut into",
    "torn into",
    "thinly sliced",
    "roughly chopped",
    "finely chopped",
    "lightly beaten",
    "beaten",
    "cored",
    "peeled",
    "melted",
    "divided",
    "optional",
)

SKIP_CONTAINS = ("prepared according to", "according to package", "according to directions", "package instructions", "prepare according")

COOKWARE = ("baking dish", "sheet pan", "skillet", "saucepan", "stockpot", "pot", "pan", "bowl", "dish", "glass dish", "ceramic dish")

PREP_ONLY = (
    "divided", "melted", "optional", "room", "temperature", "plus", "more", "thinly", "sliced", "roughly", "finely", "chopped", "cored", "peeled",
    "cut", "into", "for", "serving", "finishing", "beaten", "lightly", "stems", "removed",
)

BARE_ADJECTIVES = (
    "dry", "wet", "hot", "cold", "warm", "large", "small", "medium", "fresh", "frozen", "whole", "ground", "raw", "cooked", "drained", "rinsed",
    "packed", "heaping",
)

TAIL_PHRASES = ("plus more", "for serving", "for finishing", "cut into", "torn into", "such as", "about", "storebought or homemade", "depending on")

KEYWORD_STOPWORDS = (
    "each", "bag", "pack", "packs", "can", "cans", "jar", "jars", "box", "boxes", "bottle", "bottles", "ct", "count", "deal", "value", "multipack",
    "variety", "bulk", "tray", "shaker", "grinder", "set", "assorted", "longneck",
)

CLASSIFIER_CATEGORIES = {
    "PRODUCE": "Produce",
    "PROTEIN": "Meat & Seafood",
    "GRAIN": "Pantry",
    "SPICE": "Spices & Seasonings",
    "CONDIMENT": "Condiment & Sauces",
    "OIL_FAT": "Pantry",
    "BAKING": "Baking Goods",
    "CANNED_GOOD": "Canned & Packaged",
    "NUT_SEED": "Pantry",
    "FRESH_HERB": "Produce",
    "SWEETENER": "Baking Goods",
    "THICKENER": "Pantry",
}

BAD_CATEGORY_WORDS = ("personal care", "beauty", "household", "cleaning", "pet", "pharmacy")

CONTINUATION_WORDS = (
    "or",
    "and",
    "such as",
    "like",
    "about",
    "approximately",
    "roughly",
    "honeycrisp",
    "fuji",
    "gala",
    "granny",
    "pink lady",
    "bosc",
    "bartlett",
    "russet",
    "yukon",
    "fingerling",
    "red bliss",
    "cheddar",
    "cheese",
    "ham",
    "spiral",
    "spiral ham",
    "shank",
    "shoulder",
    "breast",
    "thigh",
    "tenderloin",
    "sirloin",
    "chuck",
    "brisket",
    "extract",
    "paste",
    "powder",
    "flakes",
    "leaves",
    "seeds",
    "beans",
    "roma",
    "cherry",
    "heirloom",
    "beefsteak",
)

PREP_FRAGMENTS = (
    "shredded",
    "drained",
    "rinsed",
    "minced",
    "chopped",
    "sliced",
    "diced",
    "grated",
    "melted",
    "softened",
    "divided",
    "crumbled",
    "toasted",
    "roasted",
    "peeled",
    "seeded",
    "trimmed",
    "halved",
    "quartered",
    "packed",
    "heaping",
    "lightly beaten",
    "room temperature",
    "at room temp",
)

MOJIBAKE = (("Â®", "®"), ("â„¢", "™"), ("Ã©", "é"), ("â€™", "'"))

STORE_ALIASES = {
    "walmart": ("Walmart",),
    "ralphs": ("Ralphs", "Ralphs Delivery Now"),
    "food4less": ("Food4Less", "Food 4 Less"),
    "stater": ("Stater Bros.", "Stater Bros. Now"),
    "sprouts": ("Sprouts", "Sprouts Farmers Market", "Sprouts Express"),
    "aldi": ("ALDI",),
    "smartfinal": ("Smart & Final", "Smart & Final Extra!"),
    "99ranch": ("99 Ranch", "99 Ranch Market"),
    "vallarta": ("Vallarta Supermarkets",),
    "cardenas": ("Cardenas Markets",),
    "super": ("El Super",),
    "northgate": ("Northgate Market",),
    "major": ("Major Market",),
}

#: What each diet leaves out and what each allergen is, as food groups.
DIET_GROUPS = {
    "Vegan": ("meat", "fish", "shellfish", "dairy", "egg", "honey"),
    "Vegetarian": ("meat", "fish", "shellfish"),
    "Pescatarian": ("meat",),
    "Dairy-Free": ("dairy",),
}
ALLERGEN_GROUPS = {
    "Peanuts": ("peanut",), "Tree Nuts": ("tree nut",), "Dairy": ("dairy",), "Egg": ("egg",), "Fish": ("fish",), "Shellfish": ("shellfish",),
    "Soy": ("soy",), "Wheat": ("wheat",),
}
#: Singular phrases by which an ingredient belongs to a food group, and longer ones that only sound like it.
FOOD_PHRASES = {
    "dairy": "milk, cheese, butter, cream, yogurt, ghee, whey, custard, kefir, buttermilk, mozzarella, cheddar, parmesan, ricotta, feta, half and half",
    "egg": "egg, egg white, egg yolk, mayonnaise, meringue",
    "fish": "fish, salmon, tuna, cod, anchovy, trout, halibut, sardine, tilapia, fish sauce",
    "shellfish": "shrimp, prawn, crab, lobster, clam, mussel, oyster, scallop",
    "soy": "soy, soybean, soy sauce, tofu, tempeh, edamame, miso",
    "wheat": "wheat, flour, bread, pasta, noodle, couscou, semolina, seitan, cracker",
    "peanut": "peanut, peanut butter",
    "tree nut": "almond, walnut, pecan, cashew, pistachio, hazelnut, macadamia",
    "meat": "beef, pork, chicken, turkey, lamb, bacon, ham, sausage, veal, duck, prosciutto, salami, gelatin, lard",
    "honey": "honey",
}
NOT_FOOD_PHRASES = {
    "dairy": "coconut milk, coconut cream, almond milk, oat milk, soy milk, rice milk, peanut butter, almond butter, cashew butter, apple butter, cocoa butter, "
    "cream of tartar, butter bean, butter lettuce, vegan cheese, vegan butter",
    "egg": "egg noodle free, eggplant, vegan mayonnaise",
    "fish": "fish free",
    "shellfish": "oyster mushroom",
    "soy": "soy free",
    "wheat": "almond flour, coconut flour, rice flour, corn flour, tapioca flour, chickpea flour, rice noodle, rice cracker, gluten free bread, gluten free pasta",
    "meat": "turkey tail, beef tomato, vegan sausage, vegan bacon, chicken of the wood",
    "honey": "honey mushroom, honeydew",
}

BLOCK_PATTERNS = ("access denied", "403", "robot", "captcha", "verify you are human", "unusual traffic", "too many requests", "rate limit")
LOCATION_PATTERNS = ("enter your address", "enter a zip", "set your location", "choose a store", "select a store")
