"""Words that name a colour, a type or a section of the catalogue. Fixed values."""

COLOURS = {
    "black": "Black", "white": "White", "blue": "Blue", "navy": "Dark Blue", "red": "Red", "green": "Green", "pink": "Pink", "beige": "Beige", "grey": "Grey", "gray": "Grey",
    "brown": "Brown", "yellow": "Yellow", "orange": "Orange", "purple": "Purple", "gold": "Gold", "silver": "Silver", "khaki": "Khaki green", "cream": "White", "ivory": "White",
}

TYPES = {
    "hoodie": "Hoodie", "hoodies": "Hoodie", "sweatshirt": "Sweater", "sweater": "Sweater", "jumper": "Sweater", "dress": "Dress", "dresses": "Dress", "trouser": "Trousers",
    "trousers": "Trousers", "pants": "Trousers", "jean": "Trousers", "jeans": "Trousers", "shirt": "Shirt", "shirts": "Shirt", "blouse": "Blouse", "top": "Top", "tops": "Top",
    "tee": "T-shirt", "t-shirt": "T-shirt", "tshirt": "T-shirt", "jacket": "Jacket", "jackets": "Jacket", "coat": "Coat", "cardigan": "Cardigan", "skirt": "Skirt", "shorts": "Shorts",
    "legging": "Leggings/Tights", "leggings": "Leggings/Tights", "tights": "Leggings/Tights", "sock": "Socks", "socks": "Socks", "shoe": "Shoes", "shoes": "Shoes",
    "sneaker": "Sneakers", "sneakers": "Sneakers", "boot": "Boots", "boots": "Boots", "bag": "Bag", "hat": "Hat/beanie", "beanie": "Hat/beanie", "scarf": "Scarf",
    "swim": "Swimwear", "swimsuit": "Swimwear",
}

SECTIONS = {
    "women": "Womenswear", "woman": "Womenswear", "womens": "Womenswear", "ladies": "Womenswear", "men": "Menswear", "man": "Menswear", "mens": "Menswear", "male": "Menswear",
    "kids": "Kids", "kid": "Kids", "children": "Kids", "baby": "Baby", "divided": "Divided",
}

STYLES = ("oversized", "linen", "summer", "winter", "minimal", "casual", "formal", "office", "sport", "sportswear", "streetwear", "cotton", "denim", "knit", "printed", "plain")
NEGATIONS = ("avoid", "dont", "isn", "no", "not", "without")
