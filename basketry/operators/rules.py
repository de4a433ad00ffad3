"""Boosts and penalties from a rule table.

A rule has a side on the ingredient, a side on the product, a channel and a
weight. Each side is an automaton over all its terms, which reads each distinct
text once; a pair of texts then only intersects two short lists of rule numbers.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("penalty", "category", "form")


@dataclass(frozen=True)
class Test:
    """How a text must look: it equals one of, contains one of, contains all of, lacks all of; has a token or whole word of."""

    eq: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    token: tuple[str, ...] = ()
    word: tuple[str, ...] = ()
    no_word: tuple[str, ...] = ()
    end: str = ""

    def clauses(self) -> tuple[list[list[tuple[str, str]]], list[tuple[str, str]]]:
        """Conditions ``(kind, term)``: lists of which one each must hold, and those of which none may."""

        def whole(words: tuple[str, ...]) -> list[tuple[str, str]]:
            return [("in" if re.search(r"[^a-zA-Z\s]", w) else "word", w) for w in words]

        wanted = [[("eq", t) for t in self.eq], [("in", t) for t in self.any], [("token", t) for t in self.token], whole(self.word),
            [("end", self.end)] if self.end else [], *([("in", t)] for t in self.all)]
        return [c for c in wanted if c], [*(("in", t) for t in self.none), *whole(self.no_word)]


@dataclass(frozen=True)
class Rule:
    """``weight`` on ``channel`` where the ingredient passes ``n`` and the product passes every test of ``p`` by field (D, C, K)."""

    name: str
    channel: str
    weight: float
    n: Test = Test()
    p: tuple[tuple[str, Test], ...] = field(default=())


def _beside(text: str, begin: int, end: int) -> bool:
    """Is the stretch a word of its own?"""
    return not any(c.isalnum() or c == "_" for c in text[max(0, begin - 1) : begin] + text[end : end + 1])


def _is_token(text: str, begin: int, end: int) -> bool:
    return text[max(0, begin - 1) : begin] in ("", " ") and text[end : end + 1] in ("", " ")


#: When an occurrence of a term at a place of a text counts.
_PLACES: dict[str, Callable[[str, int, int], bool]] = {
    "in": lambda text, begin, end: True, "word": _beside, "token": _is_token, "eq": lambda text, begin, end: begin == 0 and end == len(text),
        "end": lambda text, begin, end: end == len(text)}


class Side:
    """One side of all rules, as an automaton over their terms and postings from conditions to rules.

    A text is read once, whatever the number of rules: the automaton reports each
    occurrence of a term, and a rule holds once every list of its conditions has
    had one and none of the barred has. What a text costs beyond its length is what
    it hits. ``options`` are ``(rule, {field: Test})``; a rule may have several and holds if one does.
    """

    def __init__(self, options: Sequence[tuple[int, dict[str, Test]]]):
        self.rules = [rule for rule, _ in options]
        self.needs, self.fields = [0] * len(options), [set() for _ in options]
        conditions: dict[tuple[str, str, str], int] = {}
        self.clauses: list[list[tuple[int, int]]] = []
        self.bars: list[list[int]] = []

        def number(field_: str, kind: str, term: str) -> int:
            at = conditions.setdefault((field_, kind, term), len(conditions))
            if at == len(self.clauses):
                self.clauses.append([])
                self.bars.append([])
            return at

        for option, (_, tests) in enumerate(options):
            for field_, test in tests.items():
                wanted, barred = test.clauses()
                for one_of in wanted:
                    for kind, term in one_of:
                        self.clauses[number(field_, kind, term)].append((option, self.needs[option]))
                    self.needs[option] += 1
                for kind, term in barred:
                    self.bars[number(field_, kind, term)].append(option)
                if wanted or barred:
                    self.fields[option].add(field_)
        self.free = [i for i, n in enumerate(self.needs) if n == 0]
        self.terms: dict[str, list[tuple[str, str, int]]] = {}
        for (field_, kind, term), at in conditions.items():
            self.terms.setdefault(term, []).append((field_, kind, at))
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # built anew by each worker

    def hits(self, text: str, field_: str) -> set[int]:
        """The conditions that a text meets."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, kinds in self.terms.items():
                if term:
                    self._automaton.add_word(term, (len(term), kinds))
            self._automaton.make_automaton()
        found = {at for f, kind, at in self.terms.get("", ()) if f == field_ and (kind != "eq" or not text)}
        if self._automaton.kind == ahocorasick.AHOCORASICK:
            for last, (n, kinds) in self._automaton.iter(text):
                for f, kind, at in kinds:
                    if f == field_ and at not in found and _PLACES[kind](text, last + 1 - n, last + 1):
                        found.add(at)
        return found

    def holding(self, texts: dict[str, str | None]) -> list[int]:
        """The rules that hold for the texts of the fields; a test on a null text never does."""
        met: dict[int, set[int]] = {}
        barred: set[int] = set()
        for field_, text in texts.items():
            if text is not None:
                for at in self.hits(text, field_):
                    barred.update(self.bars[at])
                    for option, clause in self.clauses[at]:
                        met.setdefault(option, set()).add(clause)
        missing = {f for f, text in texts.items() if text is None}
        options = [*(o for o, clauses in met.items() if len(clauses) == self.needs[o]), *self.free]
        return sorted({self.rules[o] for o in options if o not in barred and not (missing & self.fields[o])})

    def numbers(self, fields: dict[str, Column]) -> Column:
        """The numbers of the rules that hold, for each row; distinct texts are looked at once a batch."""
        names = list(fields)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                columns = [rows.field(i).to_pylist() for i in range(len(names))]
                known: dict[tuple, list[int]] = {}
                out = []
                for texts in zip(*columns, strict=True):
                    if texts not in known:
                        known[texts] = self.holding(dict(zip(names, texts, strict=True)))
                    out.append(known[texts])
                yield pa.array(out, pa.list_(pa.int32()))

        return F.arrow_udf(run, "array<int>")(F.struct(*[c.cast("string").alias(n) for n, c in fields.items()]))


def ingredient_side(rules: Sequence[Rule], text: Column) -> Column:
    """Numbers of the rules whose ingredient test the text passes."""
    return Side([(i, {"N": r.n}) for i, r in enumerate(rules)]).numbers({"N": text})


def product_side(rules: Sequence[Rule], fields: dict[str, Column]) -> Column:
    """Numbers of the rules whose product tests hold; a test named "CK" may hold in either field."""
    options = []
    for i, rule in enumerate(rules):
        for chosen in itertools.product(*[name for name, _ in rule.p]):
            tests: dict[str, Test] = {}
            for field_, (_, test) in zip(chosen, rule.p, strict=True):
                if field_ in tests:
                    raise ValueError(f"{rule.name} tests one field twice")
                tests[field_] = test
            options.append((i, tests))
    return Side(options).numbers(fields)


def channel_sum(rules: Sequence[Rule], channel: str) -> Callable[[Column, Column], Column]:
    """The channel's sum for a pair of rule lists."""
    weights = F.array(*[F.lit(float(r.weight) if r.channel == channel else 0.0) for r in rules])
    return lambda n, p: F.aggregate(F.array_intersect(n, p), F.lit(0.0), lambda s, i: s + F.get(weights, i)) if rules else F.lit(0.0)


def default_rules() -> list[Rule]:
    """The grocery rules. Terms that hold a shorter term of the same list are left out, since that is found in them too."""
    rules: list[Rule] = []

    def add(name: str, channel: str, weight: float, n: Test = Test(), **p: Test) -> None:
        rules.append(Rule(name, channel, weight, n, tuple(p.items())))

    def t(*terms: str, none: tuple[str, ...] = ()) -> Test:
        return Test(any=terms, none=none)

    for hint, tokens in _by_hint().items():
        for where in "CK":
            add("R02", "category", HINT_BOOSTS[hint], Test(token=tuple(tokens)), **{where: t(hint)})
    add("R03", "category", -30, Test(token=SPIRITS), D=t(*SPIRIT_FLAVOURS))
    for name, terms in FORMS.items():
        for term in terms:
            add("R04", "form", 8, Test(eq=(name,)), D=t(term))
    for modifier, (opposites, weight) in OPPOSITES.items():
        add("R05", "penalty", weight, Test(word=(modifier,)), D=Test(word=opposites, no_word=(modifier,)))
    for term, weight in BAD_CATEGORIES.items():
        add("R06", "penalty", weight, CK=t(term))
    for term, weight in BAD_PRODUCTS.items():
        add("R07", "penalty", weight, Test(none=(term,)), D=t(term))
    for term in PREPARED:
        add("R08", "penalty", 8, Test(none=(term,)), D=t(term))
    for term, weight in (("dip", 10), ("salad", 8), ("dressing", 10), ("kit", 8)):
        add("R09", "penalty", weight, Test(none=(term,)), D=t(term))
    for name, channel, weight, n, p in _SPECIAL:
        add(name, channel, weight, n, **p)
    return rules


def _by_hint() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for token, hints in HINTS.items():
        for hint in hints:
            out.setdefault(hint, []).append(token)
    return out


# Results depend on exactly these words and weights.
HINT_BOOSTS = {"produce": 8.0, "meat": 8.0, "seafood": 8.0, "dairy": 8.0, "pantry": 5.0, "spices": 5.0, "condiment": 2.0, "bakery": 7.0, "bread": 7.0,
    "herb": 5.0, "beverage": 6.0, "adult beverage": 20.0}
HINTS: dict[str, tuple[str, ...]] = {
    "spinach": ("produce",),
    "kale": ("produce",),
    "lettuce": ("produce",),
    "onion": ("produce",),
    "garlic": ("produce",),
    "tomato": ("produce",),
    "potato": ("produce",),
    "apple": ("produce",),
    "banana": ("produce",),
    "lime": ("produce",),
    "lemon": ("produce",),
    "cilantro": ("produce",),
    "parsley": ("produce",),
    "zucchini": ("produce",),
    "eggplant": ("produce",),
    "squash": ("produce",),
    "acorn": ("produce",),
    "rosemary": ("produce", "spices", "herb"),
    "thyme": ("produce", "spices", "herb"),
    "sage": ("produce", "spices", "herb"),
    "chamomile": ("beverage", "pantry"),
    "tea": ("beverage", "pantry"),
    "chicken": ("meat",),
    "beef": ("meat",),
    "pork": ("meat",),
    "salmon": ("seafood",),
    "shrimp": ("seafood",),
    "milk": ("dairy",),
    "butter": ("dairy",),
    "yogurt": ("dairy",),
    "cheese": ("dairy",),
    "cream": ("dairy",),
    "cumin": ("spices", "pantry"),
    "paprika": ("spices", "pantry"),
    "salt": ("spices", "pantry"),
    "pepper": ("spices", "pantry"),
    "oil": ("pantry",),
    "flour": ("pantry",),
    "rice": ("pantry",),
    "pasta": ("pantry",),
    "bread": ("bakery", "bread"),
    "loaf": ("bakery", "bread"),
    "roll": ("bakery", "bread"),
    "bun": ("bakery", "bread"),
    "egg": ("dairy",),
    "cider": ("beverage",),
    "wine": ("beverage", "pantry"),
    "bourbon": ("adult beverage",),
    "rum": ("adult beverage",),
    "tequila": ("adult beverage",),
    "whiskey": ("adult beverage",),
    "whisky": ("adult beverage",),
    "vodka": ("adult beverage",),
    "gin": ("adult beverage",),
    "brandy": ("adult beverage",),
    "sherry": ("adult beverage", "pantry"),
    "champagne": ("adult beverage",),
    "prosecco": ("adult beverage",),
    "vermouth": ("adult beverage", "pantry"),
    "broth": ("pantry",),
    "stock": ("pantry",),
    "lentils": ("pantry",),
}
SPIRITS = (
    "bourbon", "rum", "tequila", "whiskey", "whisky", "vodka", "gin", "brandy",
    "sherry", "mezcal", "scotch", "cognac", "champagne", "prosecco", "vermouth", "mescal",
)
SPIRIT_FLAVOURS = ("bbq", "barbecue", "baked beans", "marinade", "seasoning", "salami", "cashews", "pulled pork", "raisin", "ice cream", "pudding",
    "morsels", "chips", "gummy", "gummies", "vinegar", "shampoo", "lipstick")
FORMS = {
    "ground cumin": ("ground",),
    "ground paprika": ("ground",),
    "ground beef": ("ground",),
    "black pepper": ("ground",),
    "olive oil": ("oil",),
    "cheddar cheese": ("cheese",),
    "chicken breast": ("breast",),
    "baby spinach": ("baby",),
    "italian bread": ("bread",),
    "acorn squash": ("acorn", "squash"),
    "apple cider": ("cider",),
    "lime": ("lime",),
    "lemon": ("lemon",),
    "rosemary": ("rosemary",),
    "potato": ("potato",),
    "apple": ("apple",),
    "chamomile tea": ("tea", "chamomile"),
}
OPPOSITES = {
    "full fat": (("reduced fat", "low fat", "fat free", "nonfat", "non fat", "light", "lite", "neufchatel"), 40.0),
    "fat free": (("whole", "full fat", "regular"), 35.0),
    "nonfat": (("whole", "full fat", "regular"), 35.0),
    "unsalted": (("salted", "sea salt", "with salt"), 45.0),
    "salted": (("unsalted",), 40.0),
    "sharp": (("mild", "medium"), 20.0),
    "whole": (("skim", "nonfat", "low fat", "reduced fat", "1%", "2%"), 35.0),
    "skim": (("whole", "full fat"), 35.0),
}
BAD_CATEGORIES = {"personal care": 45.0, "beauty": 45.0, "household": 45.0, "cleaning": 45.0, "pet": 35.0, "pharmacy": 45.0, "baby care": 35.0}
BAD_PRODUCTS = {
    "cracker": 18.0,
    "crackers": 18.0,
    "chip": 18.0,
    "chips": 18.0,
    "stick": 12.0,
    "sticks": 12.0,
    "dip": 16.0,
    "dressing": 16.0,
    "kit": 14.0,
    "snack": 16.0,
    "cookie": 18.0,
    "cookies": 18.0,
    "candy": 18.0,
    "bar": 10.0,
    "bars": 10.0,
    "smoothie": 16.0,
    "beverage": 16.0,
    "drink": 16.0,
    "juice cocktail": 18.0,
    "meal": 18.0,
    "entree": 18.0,
    "pizza": 18.0,
    "sandwich": 18.0,
    "wrap": 18.0,
    "soap": 25.0,
    "lotion": 25.0,
    "shampoo": 25.0,
    "conditioner": 25.0,
    "gummies": 18.0,
    "crisps": 18.0,
    "peanuts": 18.0,
    "nuts": 14.0,
    "sauce": 12.0,
}
PREPARED = (
    "salad", "kit", "dip", "soup", "meal", "entree", "pizza", "sandwich", "wrap", "bowl", "plate", "platter", "snack", "chips", "crackers", "cookies", "bars",
    "dessert", "ice cream", "drink", "beverage", "soda", "juice cocktail", "smoothie", "seasoned", "marinated", "breaded", "casserole", "dinner",
)
GOOD_CLASSIFIERS = ("PRODUCE", "MEAT", "SEAFOOD", "DAIRY", "DELI", "PANTRY", "BAKERY")
# Fixed values as well, down to the end of the table.
_LIQUORS = ("bourbon", "scotch", "mezcal", "gin", "tequila", "grand marnier", "amaro averna")
_PURE_SPICES = (
    "allspice", "ground allspice", "cinnamon", "ground cinnamon", "nutmeg", "ground nutmeg", "cloves", "ground cloves", "cardamom", "ground cardamom",
        "turmeric",
    "ground turmeric", "paprika", "smoked paprika", "cumin", "ground cumin", "coriander", "ground coriander", "oregano", "thyme", "rosemary", "sage",
        "bay leaf",
    "bay leaves", "ginger", "ground ginger", "cayenne", "cayenne pepper", "chili powder",
)
_MEATS = ("chicken", "beef", "bison", "pork", "turkey", "lamb", "veal", "venison", "hamburger")
_OTHER_SPICES = ("black pepper", "white pepper", "paprika", "cayenne")
_PLAIN_SUGARS = ("granulated sugar", "sugar", "brown sugar", "dark brown sugar", "powdered sugar", "cane sugar")
_NO_SUGAR = ("zero sugar", "sugar free", "sugar-free", "no sugar added", "no added sugar", "reduced sugar")
_NON_FOOD = (
    "underwear", "shirt", "pants", "jacket", "socks", "shoes", "deodorant", "shampoo", "conditioner", "lotion", "sunscreen", "cologne", "razor", "toothbrush",
    "toothpaste", "detergent", "quick-dry", "athletic wear", "sportswear", "laundry",
)


def _t(*terms: str, none: tuple[str, ...] = ()) -> Test:
    return Test(any=terms, none=none)


_PRODUCE, _HERB = {"C": _t("produce")}, {"C": _t("produce", "spices")}
_OLIVE, _BUTTER = _t("olive oil"), _t("butter", none=("peanut", "almond", "cashew", "sunflower", "apple", "nut butter"))
_ONION, _CHICKEN, _CREAM = _t("onion", none=("pearl",)), _t("chicken"), _t("cream cheese")
_SALTS = ("salt", "kosher salt", "sea salt", "table salt")
_SALTY = _t("peanut", "cashew", "almond", "pretzel", "popcorn", "chip", "cracker", "salted caramel", "salted snack")
_UNSALTED = _t("no salt added", "no-salt", "low sodium", "mixed vegetable", "canned", "vegetable blend")


def _is(*names: str) -> Test:
    return Test(eq=names)


_SPECIAL: list[tuple[str, str, float, Test, dict[str, Test]]] = [
    ("R10", "penalty", 50, _OLIVE, {"C": _t("personal care", "beauty")}),
    ("R10", "penalty", 50, _OLIVE, {"D": _t("soap", "hair", "skin", "body")}),
    ("R10", "form", 8, _OLIVE, {"D": _t("oil")}),
    ("R10", "category", 6, _OLIVE, {"C": _t("pantry", "baking")}),
    ("R11", "penalty", 24, _t("cheese"), {"D": _t("cracker", "dip", "snack", "stick")}),
    ("R11", "category", 10, _t("cheese"), {"C": _t("dairy")}),
    ("R12", "penalty", 40, _BUTTER, {"D": _t("peanut butter", "almond butter", "cashew butter", "sunflower butter", "nut butter", "cookie butter",
        "butter cup", "butter pecan", "butter bean", "butter flavor", "shea butter", "cocoa butter", "body butter")}),
    ("R12", "penalty", 50, _BUTTER, {"D": _t("shampoo", "moisturizing", "healing balm", "skin protectant")}),
    ("R12", "category", 10, _BUTTER, {"CK": _t("dairy")}),
    ("R13", "category", 10, _is("garlic"), _PRODUCE),
    ("R13", "penalty", 8, _is("garlic"), {"D": _t("paste", "stir in")}),
    ("R14", "penalty", 20, _ONION, {"D": _t("green onion", "scallion")}),
    ("R14", "penalty", 35, _ONION, {"D": _t("pearl")}),
    ("R14", "penalty", 30, _ONION, {"D": Test(word=("leek", "leeks"))}),
    ("R14", "category", 12, _ONION, _PRODUCE),
    ("R15", "penalty", 18, _is("lime", "lemon"), {"D": _t("juice")}),
    ("R15", "penalty", 20, _is("lime", "lemon"), {"D": _t("sauce")}),
    ("R15", "category", 14, _is("lime", "lemon"), _PRODUCE),
    ("R16", "penalty", 25, _t("rosemary"), {"D": _t("crisps", "cracker", "snack")}),
    ("R16", "category", 10, _t("rosemary"), _HERB),
    ("R17", "penalty", 14, _t("sage"), {"D": _t("sausage", "carrot", "glazed", "snack")}),
    ("R17", "category", 8, _t("sage"), _HERB),
    ("R18", "category", 8, _t("thyme"), _HERB),
    ("R19", "penalty", 40, _t("celery"), {"D": _t("root", "celeriac")}),
    ("R19", "penalty", 30, _t("celery"), {"D": _t("seed", none=("stalk",))}),
    ("R19", "category", 8, _t("celery"), _PRODUCE),
    ("R20", "penalty", 30, _t("chicken breast"), {"D": _t("nugget", "tender", "patty", "patties", "breaded")}),
    ("R20", "category", 8, _t("chicken breast"), {"C": _t("meat", "seafood")}),
    ("R21", "penalty", 20, _t("spinach"), {"D": _t("dip", "kit")}),
    ("R21", "category", 8, _t("spinach"), _PRODUCE),
    ("R22", "penalty", 12, _is("ground cumin"), {"D": _t("seed")}),
    ("R22", "form", 10, _is("ground cumin"), {"D": _t("ground")}),
    ("R23", "penalty", 30, _is("salt"), {"D": _t("peanut", "nut", "snack")}),
    ("R23", "category", 8, _is("salt"), {"C": _t("spices", "pantry")}),
    ("R24", "penalty", 35, _t("sugar"), {"D": _t(*_NO_SUGAR)}),
    ("R24", "penalty", 45, _t("sugar"), {"D": _t("garlic", none=("sugar",))}),
    ("R24", "penalty", 40, _is(*_PLAIN_SUGARS), {"D": _t("onion", "chili", "pepper", "seasoning", "bbq", "rub", "sauce", "marinade",
        none=("sugar", "garlic"))}),
    ("R25", "penalty", 35, _is("egg", "egg white", "egg yolk"), {"D": _t("peanut", "noodle", "snack")}),
    ("R25", "penalty", 45, _is("egg", "egg white", "egg yolk"), {"D": _t("chocolate", "candy", "marshmallow", "creme egg", "cream egg", "easter",
        "jelly bean", "fondant")}),
    ("R25", "penalty", 30, _is("egg"), {"D": _t("liquid egg white")}),
    ("R25", "penalty", 35, _is("egg"), {"D": _t("plant based")}),
    ("R25", "penalty", 20, _is("egg"), {"D": Test(word=("bites", "sandwich"))}),
    ("R25", "penalty", 25, _is("egg white"), {"D": _t("whole egg")}),
    ("R26", "form", 20, _is("acorn squash"), {"D": Test(all=("acorn", "squash"))}),
    ("R26", "category", 4, _is("acorn squash"), {"D": _t("squash", none=("acorn",))}),
    ("R26", "penalty", 10, _is("acorn squash"), {"D": Test(none=("squash",))}),
    ("R27", "category", 14, _t("bread", "loaf"), {"C": _t("bakery", "bread")}),
    ("R27", "penalty", 18, _t("bread", "loaf"), {"D": _t("bean", "mango", none=("bread",))}),
    ("R28", "category", 14, _t("squash"), _PRODUCE),
    ("R28", "penalty", 16, _t("squash", none=("banana squash",)), {"D": _t("banana")}),
    ("R28", "form", 14, Test(all=("squash", "acorn")), {"D": _t("acorn")}),
    ("R28", "penalty", 60, _t("squash"), {"D": _t("baby food", "baby pouch", "kids pouch", "serenity kids", "puree pouch", "squeeze pouch", "toddler")}),
    ("R29", "penalty", 35, _is("apple cider"), {"D": _t("vinegar")}),
    ("R29", "penalty", 30, _is("apple cider"), {"D": _t("gummies")}),
    ("R29", "form", 10, _is("apple cider"), {"D": _t("cider", "drink")}),
    ("R29", "form", 10, _is("apple cider"), {"D": Test(none=("cider", "drink")), "C": _t("beverage")}),
    ("R30", "category", 14, _is("potato"), _PRODUCE),
    ("R30", "form", 10, _is("potato"), {"D": _t("potato")}),
    ("R30", "penalty", 25, _is("potato"), {"D": _t("chip")}),
    ("R31", "category", 14, _is("apple"), _PRODUCE),
    ("R31", "form", 10, _is("apple"), {"D": _t("apple")}),
    ("R31", "penalty", 14, _is("apple"), {"D": _t("juice", "cider", "butter")}),
    ("R32", "form", 14, _is("chamomile tea"), {"D": _t("tea")}),
    ("R32", "category", 8, _is("chamomile tea"), {"C": _t("beverage", "pantry")}),
    ("R33", "penalty", 40, _is(*_LIQUORS), {"D": _t("biscuit", "sauce", "cookie", "dough")}),
    ("R34", "penalty", 50, _is(*_PURE_SPICES), {"D": _t(*_MEATS, none=("flavor",))}),
    ("R35", "penalty", 45, _is("allspice"), {"D": _t(*_OTHER_SPICES, "chili powder", "cumin", "coriander", none=("allspice",))}),
    ("R35", "penalty", 45, _is("nutmeg"), {"D": _t(*_OTHER_SPICES, none=("nutmeg",))}),
    ("R35", "penalty", 45, _is("cardamom"), {"D": _t(*_OTHER_SPICES, "coriander", "cumin", none=("cardamom",))}),
    ("R35", "penalty", 45, _is("cloves"), {"D": _t(*_OTHER_SPICES, none=("cloves",))}),
    ("R36", "penalty", 45, _is("salt"), {"D": _SALTY}),
    ("R36", "penalty", 60, _is("salt"), {"D": _UNSALTED}),
    ("R36", "penalty", 45, Test(end=" salt"), {"D": _SALTY}),
    ("R36", "penalty", 60, Test(end=" salt"), {"D": _UNSALTED}),
    ("R37", "penalty", 40, _t("carrot", "celery", "zucchini", "squash", "beet", "parsnip", "turnip", "sweet potato", "yam"),
        {"D": _t("cake", "muffin", "cookie", "loaf", "bread", "bar", "brownie", "dessert", "smoothie", "juice blend")}),
    ("R38", "penalty", 50, _is("egg white", "egg whites"), {"D": _t("ham", "sausage", "bacon", "gruyere", "bite", "sandwich", "wrap", "burrito",
        "meal", "entree")}),
    ("R39", "penalty", 200, Test(), {"D": _t(*_NON_FOOD)}),
    ("R40", "penalty", 100, _t("scotch bonnet"), {"D": _t("whiskey", "whisky", "bourbon", "spirit", "liquor")}),
    ("R40", "penalty", 100, Test(all=("scotch", "pepper"), none=("scotch bonnet",)), {"D": _t("whiskey", "whisky", "bourbon", "spirit", "liquor")}),
    ("R41", "penalty", 40, _is(*_LIQUORS), {"D": _t("biscuit", "sauce", "cookie", "dough")}),
    ("R41", "penalty", 50, _is("bourbon"), {"D": _t("barrel aged", "wine", "cabernet", "sauvignon", "pinot", "chardonnay")}),
    ("R42", "penalty", 45, _t("rosemary"), {"D": _t("cheese", "ham", "turkey", "massage oil", "cracker", "crisps")}),
    ("R42", "category", 10, _t("rosemary"), _HERB),
    ("R43", "penalty", 50, _OLIVE, {"D": _t("mayo", "vinegar", "dressing", "marinade", "spray")}),
    ("R44", "penalty", 40, _t("chamomile"), {"D": _t("iced tea", "half and half", "lemon tea", "peach tea", "green tea")}),
    ("R45", "penalty", 55, _t("miso"), {"D": _t("onion", "mushroom", "potato", "turnip", "radish", "parsnip")}),
    ("R45", "form", 20, _t("miso"), {"D": _t("miso")}),
    ("R46", "penalty", 40, _t("flour", none=("tortilla",)), {"D": _t("tortilla", "chip", "bread crumb", "breadcrumb", "breading")}),
    ("R47", "penalty", 45, _t("rice", none=("flour",)), {"D": _t("rice flour", "rice cake", "rice cracker", "rice crisp", "rice puff", "rice syrup")}),
    ("R48", "penalty", 70, _t("evaporated milk", "condensed milk"), {"D": _t("oat milk", "oatmilk", "almond milk", "soy milk", "plant milk",
        "rice milk", "cashew milk", "hemp milk", "oat beverage")}),
    ("R49", "penalty", 65, Test(all=("vanilla", "extract")), {"D": _t("oatmilk", "oat milk", "almond milk", "soy milk", "coconut milk", "plant milk")}),
    ("R50", "penalty", 60, _t("yogurt"), {"D": _t("almond milk", "oat milk", "oatmilk", "soy milk", "rice milk", "coconut milk beverage", none=("yogurt",))}),
    ("R51", "penalty", 50, _is("whole milk", "milk", "skim milk", "lowfat milk"),
        {"D": _t("cheese", "mozzarella", "shredded", "chocolate egg", "candy", "ice cream", "peanut butter", "frozen dessert")}),
    ("R51", "penalty", 80, _is("whole milk", "milk", "skim milk", "lowfat milk"),
        {"D": _t("deodorant", "shampoo", "lotion", "sunscreen", "body spray", "conditioner")}),
    ("R52", "penalty", 40, _t("onion powder"), {"D": _t("diced", "fresh", "whole onion", "onion bag", "fajita", "bell pepper")}),
    ("R53", "penalty", 45, _t("brown sugar"), {"D": _t("pearl")}),
    ("R53", "penalty", 30, _t("brown sugar"), {"D": _t("coffee pod", "bbq", "marinade")}),
    ("R54", "penalty", 45, Test(all=("cumin", "seed")), {"D": _t("pumpkin", "sesame", "chia", "sunflower", "poppy", "hemp", "flax")}),
    ("R54", "penalty", 45, Test(all=("cumin", "seed")), {"D": Test(none=("cumin",))}),
    ("R55", "penalty", 40, _CREAM, {"D": _t("dairy free", "vegan", "non dairy", "nondairy")}),
    ("R55", "penalty", 40, _CREAM, {"D": _t("cinnamon roll", "carrot cake", "icing", "frosting", "imitation crab", "toaster strudel", "pastry",
        "cake", "sushi", "strudel")}),
    ("R55", "penalty", 50, _CREAM, {"D": _t("feta")}),
    ("R56", "penalty", 40, _t("scallion", "green onion"), {"D": _t("noodle", "pasta", "ramen", "stir fry", "sauce", "seasoning", "dip", "cream cheese")}),
    ("R57", "penalty", 50, _CHICKEN, {"D": _t("lunch meat", "deli", "buddig", "chicken salad kit", "chicken snack")}),
    ("R57", "penalty", 40, _CHICKEN, {"D": _t("vienna sausage")}),
    ("R57", "penalty", 50, _CHICKEN, {"D": _t("ground chicken")}),
    ("R57", "penalty", 55, _CHICKEN, {"D": _t("wing", "tender", "nugget", "strip", "patty", "patties", "cutlet", "baked", "breaded", "popcorn chicken")}),
    ("R58", "penalty", 50, Test(all=("italian",), any=("loaf", "bread")), {"D": _t("crumb")}),
    ("R59", "penalty", 60, _is("sugar", "granulated sugar", "white sugar", "cane sugar", "pure cane sugar"),
        {"D": _t("egg white", "liquid egg", "arepa", "corn meal", "cornmeal")}),
    ("R60", "form", 20, Test(all=("lentil", "soup")), {"D": _t("soup")}),
    ("R60", "penalty", 35, Test(all=("lentil", "soup")), {"D": _t("lentil", none=("soup",))}),
]
