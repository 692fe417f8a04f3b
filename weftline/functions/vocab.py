"""The controlled vocabulary. Fixed values."""

CATEGORIES = ("top", "bottom", "dress", "outerwear", "shoes", "bag", "accessory")
GENDERS = ("men", "women", "unisex", "kid")
FORMALITIES = ("athletic", "casual", "smart_casual", "formal")
FORMALITY_RELEVANT = ("top", "bottom", "dress", "shoes", "outerwear")
SIZES = ("XS", "S", "M", "L", "XL", "XXL")
COMPLEMENTS = {
    "top": ("bottom", "outerwear", "shoes", "bag", "accessory"),
    "bottom": ("top", "outerwear", "shoes", "bag", "accessory"),
    "dress": ("outerwear", "shoes", "bag", "accessory"),
    "outerwear": ("top", "bottom", "dress", "shoes", "bag", "accessory"),
    "shoes": ("top", "bottom", "dress", "outerwear", "bag", "accessory"),
    "bag": ("top", "bottom", "dress", "outerwear", "shoes", "accessory"),
    "accessory": ("top", "bottom", "dress", "outerwear", "shoes", "bag"),
}
OCCASIONS = ("office", "interview", "school", "date", "cafe_hangout", "party", "wedding", "home_casual", "travel")
STYLES = ("minimalist", "korean", "streetwear", "elegant", "casual", "vintage", "sporty", "feminine")
BODY_SHAPES = ("pear", "apple", "hourglass", "rectangle", "inverted_triangle")
SEASONS = ("summer", "transitional", "winter", "rainy")
PRICE_TIERS = ("budget", "mid", "premium")
SKIN_TONES = ("warm", "neutral", "cool")
#: Occasions that a formality band suits, and styles that it tells ("classic" is no style of the vocabulary).
FORMALITY_OCCASIONS = {
    "athletic": ("home_casual", "travel", "school"),
    "casual": ("school", "cafe_hangout", "home_casual", "travel", "date"),
    "smart_casual": ("office", "interview", "school", "date", "cafe_hangout", "party"),
    "formal": ("office", "interview", "wedding", "party", "date"),
}
FORMALITY_STYLES = {"formal": ("elegant", "classic"), "smart_casual": ("minimalist", "korean"), "casual": ("casual",), "athletic": ("sporty",)}
