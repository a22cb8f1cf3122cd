"""Word lists, lookup tables and templates whose content decides the results."""

YES_WORDS = ("yes", "y", "true", "1")
NO_WORDS = ("no", "n", "false", "0")

# Irregular plurals of the pair renderer and of the clean minimal-pair builder.
IRREGULAR_PLURALS = {
    "person": "people", "man": "men", "woman": "women", "child": "children", "mouse": "mice",
    "tooth": "teeth", "foot": "feet", "sheep": "sheep", "deer": "deer",
}
CLEAN_IRREGULAR_PLURALS = {
    "person": "people", "man": "men", "woman": "women", "child": "children", "foot": "feet",
    "tooth": "teeth", "mouse": "mice", "sheep": "sheep", "fish": "fish",
}
NUMBER_WORDS = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six"}

# Name quality.
BAD_OBJECT_NAMES = (
    "object", "objects", "thing", "things", "stuff", "area", "part", "item", "items", "something",
    "anything", "other", "others", "unknown", "none",
)
BAD_ATTRIBUTES = (
    "very", "other", "same", "own", "possible", "visible", "unknown", "different", "many", "some",
    "several", "few",
)
VAGUE_RELATIONS = ("of", "with", "by", "at", "from", "for", "has", "have", "had", "belonging to")

# Attribute buckets.
COLOR_ATTRIBUTES = (
    "black", "blue", "brown", "gray", "grey", "green", "orange", "pink", "purple", "red", "tan",
    "white", "yellow", "silver", "gold", "golden",
)
SIZE_ATTRIBUTES = ("big", "small", "large", "little", "tiny", "tall", "short", "long", "wide", "narrow")
MATERIAL_ATTRIBUTES = (
    "wooden", "wood", "metal", "metallic", "plastic", "glass", "brick", "concrete", "leather",
    "cloth", "paper", "stone",
)
STATE_ATTRIBUTES = (
    "open", "closed", "full", "empty", "clean", "dirty", "wet", "dry", "standing", "sitting",
    "lying", "parked", "cut", "broken",
)

# Relation aliases: scene-graph sets, clean minimal pairs, subtype minimal pairs.
SCENE_RELATION_ALIASES = {
    "to the left of": "left of", "left of": "left of", "to the right of": "right of",
    "right of": "right of", "in the front of": "in front of", "in front of": "in front of",
    "in back of": "behind", "at the back of": "behind", "on top of": "on", "inside of": "inside",
}
CLEAN_RELATION_ALIASES = {
    "left": "left of", "to the left of": "left of", "right": "right of", "to the right of": "right of",
    "over": "above", "on top of": "above", "under": "below", "beneath": "below",
    "holding": "holding", "hold": "holding", "wearing": "wearing", "wear": "wearing",
    "sitting": "sitting on", "sitting on": "sitting on", "riding": "riding", "ride": "riding",
    "standing next to": "standing beside", "standing beside": "standing beside", "next to": "standing beside",
}
SUBTYPE_RELATION_ALIASES = {
    "to the left of": "left of", "left": "left of", "to the right of": "right of", "right": "right of",
    "over": "above", "under": "below", "beneath": "below",
}
# Relation records: predicate -> key; other predicates get underscores for spaces.
RECORD_RELATION_ALIASES = {
    "left": "left_of", "left of": "left_of", "to the left of": "left_of",
    "right": "right_of", "right of": "right_of", "to the right of": "right_of",
    "top": "above", "on top of": "above", "above": "above", "below": "below", "bottom": "below",
    "in": "in", "inside": "inside", "under": "under", "underneath": "under", "beside": "beside",
    "next": "next_to", "next to": "next_to", "near": "near", "close to": "close_to",
    "in front of": "in_front_of", "front of": "in_front_of", "behind": "behind",
    "carry": "carrying", "carrying": "carrying", "eat": "eating", "eating": "eating",
    "drink": "drinking", "drinking": "drinking", "look at": "looking_at", "looking at": "looking_at",
    "watch": "watching", "watching": "watching", "play with": "playing_with", "playing with": "playing_with",
    "use": "using", "using": "using", "holding": "holding", "hold": "holding",
    "riding": "riding", "ride": "riding", "wearing": "wearing", "wear": "wearing",
    "touching": "touching", "touch": "touching", "direct contact": "direct_contact",
    "contact": "direct_contact", "on": "on",
}
RECORD_VAGUE_RELATIONS = ("", "of", "with", "by", "at", "around", "surrounding", "surrounded_by")
RELATION_PHRASES = {
    "left_of": "to the left of", "right_of": "to the right of", "close_to": "close to",
    "next_to": "next to", "in_front_of": "in front of", "looking_at": "looking at",
    "playing_with": "playing with", "direct_contact": "in direct contact with",
}
RECORD_OPPOSITES = {
    "left_of": "right_of", "right_of": "left_of", "above": "below", "below": "above",
    "on": "under", "under": "on", "in_front_of": "behind", "behind": "in_front_of",
}
RELATION_BUCKETS = {
    "horizontal": ("left_of", "right_of"),
    "vertical": ("above", "below", "under"),
    "depth": ("in_front_of", "behind"),
    "contact": ("on", "in", "inside", "next_to", "near", "beside", "close_to", "touching", "direct_contact"),
    "interaction": (
        "holding", "riding", "wearing", "carrying", "eating", "drinking", "looking_at", "watching",
        "playing_with", "using",
    ),
}
BUCKET_ORDER = ("horizontal", "vertical", "depth", "contact", "interaction", "semantic")
BUCKET_RATIO = {"horizontal": 0.5, "vertical": 0.1, "depth": 0.15, "contact": 0.15, "interaction": 0.1, "semantic": 0.0}
# Subtype of a relation record by bucket.
BUCKET_SUBTYPES = {
    "horizontal": "rel_position_horizontal", "vertical": "rel_position_vertical",
    "depth": "rel_position_depth", "contact": "rel_contact", "interaction": "rel_interaction",
    "semantic": "rel_semantic",
}

# Counter values.
OPPOSITE_RELATION = {"left of": "right of", "right of": "left of", "above": "below", "below": "above"}
COLOR_NEGATIVES = ("black", "white", "red", "yellow", "green", "blue", "brown", "orange")
CONTACT_COUNTERS = {
    "holding": "wearing", "wearing": "holding", "riding": "standing beside",
    "sitting on": "standing next to", "standing on": "sitting next to", "carrying": "touching",
    "eating": "holding", "touching": "carrying", "lying on": "standing next to",
    "leaning on": "standing beside",
}
STATE_PAIRS = {
    "open": "closed", "closed": "open", "full": "empty", "empty": "full", "clean": "dirty",
    "dirty": "clean", "wet": "dry", "dry": "wet", "on": "off", "off": "on", "broken": "intact",
    "intact": "broken",
}
MATERIAL_ALIASES = {
    "wood": "wooden", "wooden": "wooden", "metal": "metal", "metallic": "metal", "glass": "glass",
    "plastic": "plastic", "cloth": "cloth", "leather": "leather", "stone": "stone", "paper": "paper",
}
MATERIAL_PAIRS = {
    "wooden": "metal", "metal": "wooden", "glass": "plastic", "plastic": "glass", "cloth": "leather",
    "leather": "cloth", "stone": "wooden", "paper": "plastic",
}
SHAPE_PAIRS = {
    "round": "square", "square": "round", "circular": "rectangular", "rectangular": "circular",
    "long": "short", "short": "long", "flat": "curved", "curved": "flat",
}
ACTION_PAIRS = {
    "standing": "sitting", "sitting": "standing", "running": "standing", "walking": "standing",
    "sleeping": "awake", "awake": "sleeping", "flying": "standing", "lying": "standing",
}

# Clean minimal pairs: palettes, whitelists and selection shares.
CLEAN_COLORS = ("black", "white", "red", "blue", "green", "yellow", "brown", "gray", "orange", "pink", "purple")
COLOR_OBJECTS = (
    "car", "bus", "truck", "train", "boat", "shirt", "hat", "dress", "jacket", "pants", "shoes",
    "shoe", "umbrella", "bag", "backpack", "chair", "table", "bench", "sofa", "bed", "bottle",
    "cup", "sign", "building",
)
COUNT_OBJECTS = (
    "person", "man", "woman", "boy", "girl", "car", "bus", "truck", "bicycle", "motorcycle", "dog",
    "cat", "horse", "cow", "sheep", "bird", "chair", "cup", "bottle", "book", "umbrella", "bag",
)
REL_OBJECTS = (
    "person", "man", "woman", "boy", "girl", "car", "bus", "truck", "bicycle", "motorcycle", "dog",
    "cat", "horse", "cow", "sheep", "bird", "chair", "table", "bench", "sofa", "bed", "cup",
    "bottle", "plate", "bowl", "book", "bag", "umbrella",
)
PART_STUFF = (
    "leg", "legs", "arm", "arms", "hand", "hands", "foot", "feet", "hair", "ear", "ears", "beak",
    "leaf", "leaves", "sky", "grass", "ground", "wall", "road", "floor", "post", "pole", "letters",
    "letter", "shadow", "water", "seafood", "shrimp", "clouds", "cloud", "window", "windows", "tree",
    "trees",
)
STATE_OBJECTS = ("door", "window", "umbrella", "bottle", "cup", "plate", "light", "lamp", "screen", "sign", "bag")
MATERIAL_OBJECTS = ("table", "chair", "bench", "bottle", "cup", "bag", "jacket", "sofa", "sign", "box")
SHAPE_OBJECTS = ("sign", "plate", "table", "window", "mirror", "clock", "board", "box", "cake")
ACTION_OBJECTS = ("person", "man", "woman", "boy", "girl", "dog", "cat", "bird", "horse")
PERSON_SUBJECTS = ("person", "man", "woman", "boy", "girl")
SIT_RIDE_SUBJECTS = PERSON_SUBJECTS + ("dog", "cat")
HOLDING_OBJECTS = (
    "umbrella", "phone", "cup", "bottle", "bat", "racket", "bag", "book", "knife", "frisbee", "hat",
    "helmet", "backpack", "glasses",
)
WEAR_HOLD_DUAL = ("hat", "helmet", "backpack", "glasses", "bag")
SITTING_OBJECTS = ("chair", "bench", "sofa", "bed")
RIDING_OBJECTS = ("horse", "bicycle", "motorcycle", "skateboard")
SELECTION_SHARES = {"object": 0.15, "subject": 0.15, "value": 0.30, "predicate": 0.45}

# Audits.
GRAMMAR_PATTERNS = (
    "Are there one", "There are one", "watchs", "womans", "feets", "shoes is", "pants is",
    "There is a pants", "There is a shoes",
)
PREDICATE_PHRASES = (
    "sitting on", "standing on", "standing next to", "riding", "holding", "wearing", "carrying",
    "eating", "touching", "lying on", "leaning on", "left of", "right of", "above", "below",
    "in front of", "behind",
)

# Template bank: (subtype, template_id, question, response).
TEMPLATES = (
    ("cat", "cat_tpl_001", "What category best describes the object in the image?", "The object is a {label}."),
    ("cat", "cat_tpl_002", "Which label matches the visible object?", "The correct label is {label}."),
    ("cat", "cat_tpl_003", "Identify the category of the salient object.", "This image contains a {label}."),
    ("cat", "cat_tpl_004", "What is the object category shown here?", "The shown category is {label}."),
    ("cnt", "cnt_tpl_001", "How many {obj_pl} are visible in the image?", "The image shows {count} {obj_count}."),
    ("cnt", "cnt_tpl_002", "What is the count of {obj_pl} in the scene?", "The scene contains {count} {obj_count}."),
    ("cnt", "cnt_tpl_003", "Report the number of {obj_pl} present.", "The visible count is {count} {obj_count}."),
    ("col", "col_tpl_001", "What color is the {obj}?", "The {obj} is {color}."),
    ("col", "col_tpl_002", "Identify the color of the {obj} in the image.", "The visible {obj} appears {color}."),
    ("col", "col_tpl_003", "Which color best matches the {obj}?", "The {obj} has a {color} color."),
    ("rel", "rel_tpl_001", "What is the spatial relation between the {obj1} and the {obj2}?", "The {obj1} is {rel} the {obj2}."),
    ("rel", "rel_tpl_002", "How is the {obj1} positioned relative to the {obj2}?", "The {obj1} is located {rel} the {obj2}."),
    ("rel", "rel_tpl_003", "Describe the relation of the {obj1} to the {obj2}.", "The relation is that the {obj1} is {rel} the {obj2}."),
)
TEMPLATE_SLOTS = {
    "cat": ("label",), "cnt": ("count", "obj_pl", "obj_count"), "col": ("obj", "color"), "rel": ("obj1", "obj2", "rel"),
}
TARGET_SLOT = {"cat": "label", "cnt": "count", "col": "color", "rel": "rel"}
DEFAULT_TARGETS = {"cat": 500, "cnt": 500, "col": 200, "rel": 500}

# Router labels by priority of the primary label, and the words that raise each score.
ROUTER_LABELS = ("cat", "attr_count", "attr_color", "attr_action_state", "rel_spatial", "rel_contact_missing", "unknown")
ROUTER_PRIORITY = ("rel_contact_missing", "rel_spatial", "attr_count", "attr_color", "attr_action_state", "cat", "unknown")
ROUTER_COUNT = ("how many", "number", "total", "count", "one", "two", "three", "four", "five", "six")
ROUTER_COLOR = ("red", "blue", "green", "yellow", "black", "white", "gray", "grey", "brown", "orange", "color", "colour")
ROUTER_ACTION = ("sitting", "standing", "running", "lying", "holding", "wearing", "riding", "carrying")
ROUTER_SPATIAL = ("left", "right", "above", "below", "top", "bottom")
ROUTER_CONTACT = ("direct contact", "touch", "touching")
# Rule router keywords, substring match.
RULE_ATTR = ("how many", "number", "count", "color", "what color", "many")
RULE_REL = ("left", "right", "above", "below", "under", "next to", "behind", "in front of", "position", "where")
RULE_CAT = ("object", "is there", "does image contain", "what is in", "what objects", "contain")

# Question classifier, substring mode.
CLASS_COUNT = ("how many", "number", "total", "count", " one ", " two ", " three ", " four ", " five ")
CLASS_COLOR = ("color", "colour", "red", "blue", "green", "yellow", "black", "white", "brown", "orange", "gray", "grey")
CLASS_ACTION = ("sitting", "standing", "running", "lying", "holding", "wearing", "riding", "carrying")
# Question classifier, whole-word mode.
WORD_COUNT = ("how many", "number of", "count", "quantity", "several", "many")
WORD_COLOR = ("color", "colour", "red", "blue", "green", "yellow", "black", "white", "brown", "gray", "grey", "orange", "pink", "purple")
WORD_ACTION = ("doing", "holding", "wearing", "riding", "sitting", "standing", "walking", "running", "eating", "playing")
WORD_STATE = ("open", "closed", "clean", "dirty", "full", "empty", "wet", "dry", "old", "new", "broken")

# Which other subtypes serve as mismatched controls of a subtype.
MISMATCHED_SUBTYPES = {
    "attr_color_clean": ("attr_count_clean", "attr_state_clean", "rel_left_right_clean"),
    "attr_count_clean": ("attr_color_clean", "attr_action_single_clean", "rel_holding_wearing_clean"),
    "attr_state_clean": ("attr_material_clean", "attr_action_single_clean", "rel_sitting_riding_clean"),
    "attr_material_clean": ("attr_shape_clean", "attr_color_clean", "rel_holding_wearing_clean"),
    "attr_shape_clean": ("attr_material_clean", "attr_color_clean", "rel_left_right_clean"),
    "attr_action_single_clean": ("attr_state_clean", "rel_sitting_riding_clean", "rel_holding_wearing_clean"),
    "rel_left_right_clean": ("rel_above_below_clean", "attr_color_clean", "attr_action_single_clean"),
    "rel_above_below_clean": ("rel_left_right_clean", "attr_color_clean", "attr_shape_clean"),
    "rel_holding_wearing_clean": ("rel_sitting_riding_clean", "attr_action_single_clean", "attr_count_clean"),
    "rel_sitting_riding_clean": ("rel_holding_wearing_clean", "attr_action_single_clean", "attr_state_clean"),
}
