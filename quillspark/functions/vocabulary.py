"""Word lists of the receipt domain, in Malay and English.

Fixed values: the words, their order and the numbers in this module are part of
the results' definition and must stay as they are.
"""

from __future__ import annotations

#: Amount labels by entity type. Matching tries longer labels first, then this order.
MONEY_LABELS = {
    "SUBTOTAL": ["jumlah kecil", "jumlah sebelum cukai", "sub jumlah", "subjumlah", "sub total", "subtotal", "sub-total", "amount before tax"],
    "TAX": ["cukai sst", "cukai gst", "cukai jualan", "cukai perkhidmatan", "cukai", "sst 6%", "gst 6%", "sst", "gst", "service tax", "sales tax", "tax", "vat"],
    "TOTAL": [
        "total after adjustment", "total after adj", "total after rounding", "jumlah selepas pelarasan", "jumlah selepas adj", "total inclusive of gst",
        "total incl gst", "total incl. gst", "total sales incl gst", "total sales inclusive of gst", "jumlah besar", "jumlah keseluruhan", "jumlah bayaran",
        "jumlah akhir", "grand total", "total amount", "nett total", "net total", "total due", "amount due", "jumlah", "amaun", "total", "netto",
    ],
    "PAID": ["tunai", "wang tunai", "bayaran tunai", "dibayar", "jumlah dibayar", "cash", "amount paid", "paid", "payment", "kad kredit", "kad debit"],
    "CHANGE": ["baki", "wang baki", "duit baki", "change", "changes", "balance"],
}

#: Labels that name the amount payable and nothing else.
FINAL_TOTALS = [
    "jumlah besar", "jumlah keseluruhan", "jumlah akhir", "jumlah bayaran", "grand total", "total amount", "nett total", "net total", "total due", "amount due",
    "total after adjustment", "total after adj", "total after rounding", "jumlah selepas pelarasan", "jumlah selepas adj", "total inclusive of gst", "total incl gst", "total incl. gst",
]

SUMMARY_HEADERS = ["gst summary", "sst summary", "tax summary", "summary of gst", "ringkasan cukai", "ringkasan gst", "gst analysis", "tax analysis", "gst breakdown"]

DATE_LABELS = ["tarikh", "tkh", "date", "dated", "tarikh resit"]
TIME_LABELS = ["masa", "waktu", "time", "jam"]
INVOICE_LABELS = [
    "no. resit", "no resit", "nombor resit", "resit no", "resit", "no. invois", "no invois", "invois", "invoice no", "invoice", "inv no", "inv", "bill no",
    "bil no", "receipt no", "receipt", "no. transaksi", "trans no", "slip no", "doc no", "struk",
]
TAX_ID_LABELS = ["no. cukai", "no cukai", "nombor cukai", "gst id", "gst no", "gst reg", "sst id", "sst no", "sst reg", "tax id", "tax no", "gst", "sst", "roc", "no. pendaftaran", "reg no"]
PHONE_LABELS = ["tel", "telefon", "no. tel", "no tel", "phone", "hp", "h/p", "fax", "faks"]
CASHIER_LABELS = ["juruwang", "kasir", "cashier", "served by", "dilayan oleh", "operator"]

PAYMENT_METHODS = {
    "CASH": ["tunai", "cash", "wang tunai"],
    "CREDIT_CARD": ["kad kredit", "credit card", "visa", "mastercard", "master card", "amex"],
    "DEBIT_CARD": ["kad debit", "debit card", "debit"],
    "EWALLET": ["touch n go", "touch 'n go", "tng", "grabpay", "boost", "shopeepay", "e-wallet", "ewallet", "dompet digital"],
    "QR": ["duitnow", "duit now", "qr pay", "qr code", "scan qr"],
    "ONLINE": ["online banking", "fpx", "bank transfer", "pindahan bank"],
}

MONTHS = {
    "januari": 1, "februari": 2, "mac": 3, "april": 4, "mei": 5, "jun": 6, "julai": 7, "ogos": 8, "september": 9, "oktober": 10, "november": 11, "disember": 12,
    "jan": 1, "feb": 2, "apr": 4, "jul": 7, "ogo": 8, "sep": 9, "okt": 10, "nov": 11, "dis": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10, "december": 12,
    "mar": 3, "aug": 8, "oct": 10, "dec": 12,
}
DAY_NAMES = [
    "isnin", "selasa", "rabu", "khamis", "jumaat", "sabtu", "ahad", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "wed", "thu", "fri", "sat", "sun",
]

COMPANY_MARKERS = [
    "sdn bhd", "sdn. bhd", "bhd", "enterprise", "enterprises", "trading", "perniagaan", "kedai", "restoran", "restaurant", "cafe", "kafe", "gerai",
    "mini market", "minimarket", "supermarket", "pasar raya", "pasaraya", "hardware", "pharmacy", "farmasi", "klinik", "clinic", "berhad", "holdings",
    "services", "servis", "motor", "auto", "stationery", "bakery", "catering", "resources", "marketing", "industries", "plt",
]
ADDRESS_MARKERS = [
    "jalan", "jln", "lorong", "lrg", "taman", "tmn", "kampung", "kg", "bandar", "seksyen", "sekysen", "persiaran", "lebuh", "lebuhraya", "bangunan",
    "blok", "tingkat", "wisma", "plaza", "batu", "mukim", "daerah", "pekan", "kompleks",
]
PLACES = [
    "johor", "kedah", "kelantan", "melaka", "malacca", "negeri sembilan", "pahang", "perak", "perlis", "pulau pinang", "penang", "sabah", "sarawak",
    "selangor", "terengganu", "kuala lumpur", "labuan", "putrajaya", "johor bahru", "johor baru", "iskandar puteri", "batu pahat", "muar", "kluang",
    "kulai", "pontian", "segamat", "alor setar", "sungai petani", "kulim", "langkawi", "kota bharu", "ayer keroh", "seremban", "nilai", "port dickson",
    "kuantan", "temerloh", "bentong", "ipoh", "taiping", "teluk intan", "sitiawan", "kangar", "george town", "butterworth", "bayan lepas",
    "bukit mertajam", "kota kinabalu", "sandakan", "tawau", "kuching", "miri", "sibu", "bintulu", "shah alam", "petaling jaya", "subang jaya", "klang",
    "kajang", "bangi", "cyberjaya", "rawang", "puchong", "cheras", "ampang", "setapak", "wangsa maju", "sepang", "kuala terengganu", "kemaman",
    "dungun", "batang kali", "bandar utama", "damansara", "mont kiara", "sri hartamas", "bukit bintang", "sentul",
]
NOISE_PHRASES = [
    "tax invoice", "invois cukai", "resit jualan", "sales receipt", "simplified tax invoice", "cash bill", "bil tunai", "official receipt", "terima kasih",
    "terima kaseh", "thank you", "thank u", "thanks", "tq for", "tq!", "sila datang lagi", "please come again", "barang yang dijual", "goods sold",
    "tidak boleh dipulangkan", "not refundable", "no refund", "selamat datang", "welcome", "customer copy", "salinan pelanggan",
]
TAX_INCLUSIVE_MARKERS = [
    "inclusive of gst", "inclusive of sst", "inclusive of tax", "gst inclusive", "sst inclusive", "tax inclusive", "incl. gst", "incl gst",
    "price inclusive", "prices inclusive", "inclusive gst", "termasuk gst", "termasuk sst", "termasuk cukai", "harga termasuk", "termasuk dalam harga",
]

MALAY_WORDS = [
    "jumlah", "tunai", "baki", "cukai", "tarikh", "masa", "resit", "harga", "kedai", "jalan", "terima", "kasih", "bayaran", "barang", "kuantiti", "sila",
    "datang", "lagi", "syarikat", "perniagaan", "besar", "kecil", "dan", "yang", "untuk", "dengan", "pada", "juruwang", "invois", "wang",
]
ENGLISH_WORDS = [
    "total", "cash", "change", "tax", "date", "time", "receipt", "price", "shop", "street", "thank", "you", "payment", "item", "items", "quantity",
    "please", "come", "again", "company", "invoice", "amount", "subtotal", "the", "and", "for", "with", "cashier",
]

#: Glyphs that character recognition confuses with digits, and the digits.
GLYPHS, DIGITS = "ODQolI|iSsZzBGgTb", "00001111552286676"
#: Standing alone, these are rules, borders and logo strokes.
GRAPHIC = "|¦‖—–_=~<>*\\─│┌┐└┘├┤┬┴┼█"
#: Marks that stand for a decimal point after recognition.
POINT = ".,\\-–—="

#: Entity types with one value to a document -> name of the field.
FIELDS = {
    "MERCHANT": "merchant", "ADDRESS": "address", "PHONE": "phone", "TAX_ID": "tax_id", "INVOICE_NO": "invoice_no", "DATE": "date", "TIME": "time",
    "SUBTOTAL": "subtotal", "TAX": "tax", "TOTAL": "total", "PAID": "paid", "CHANGE": "change", "PAYMENT_METHOD": "payment_method", "CURRENCY": "currency",
    "CASHIER": "cashier",
}
MONEY_TYPES = ["SUBTOTAL", "TAX", "TOTAL", "PAID", "CHANGE"]
SEMANTIC_TYPES = ["MERCHANT", "ADDRESS", "ITEM", "CASHIER"]
LOCATION_TYPES = ["ADDRESS", "MERCHANT"]
#: Coarse classes of entity types; any other type is MISC.
COARSE = {
    "MERCHANT": "ORG", "ADDRESS": "LOC", "PHONE": "MISC", "TAX_ID": "MISC", "INVOICE_NO": "MISC", "DATE": "TIME", "TIME": "TIME", "ITEM": "PRODUCT", "SUBTOTAL": "MONEY",
    "TAX": "MONEY", "TOTAL": "MONEY", "PAID": "MONEY", "CHANGE": "MONEY", "CURRENCY": "MISC", "PAYMENT_METHOD": "MISC", "CASHIER": "PERSON",
}
