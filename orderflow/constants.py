"""Fixed values that must equal the source application's for equal results.

Kept together, as plain text, in their natural order.
"""

# --- fixed values: order status life cycle -------------------------------
STATUSES = ["waiting", "making", "ready", "complete"]
DEFAULT_STATUS = "waiting"
READY_STATUSES = ["ready", "complete"]       # both shown as "ready for pickup"
BOARD_STATUSES = ["waiting", "making"]       # rows on the live board

# --- fixed values: catalogue defaults ------------------------------------
DEFAULT_SYRUPS = ["Caramel", "Sugar Free Caramel", "Vanilla", "Sugar Free Vanilla",
                  "Mocha", "White Chocolate", "Honey", "Cinnamon Powder", "Hazelnut"]
DEFAULT_MILKS = ["Whole milk", "Almond milk", "Oat milk", "Soy milk"]
# the spreadsheet backend's fallback milk list (no whole milk)
SHEET_DEFAULT_MILKS = ["Almond milk", "Oat milk", "Soy milk"]
INGREDIENT_TYPES = ["syrup", "milk"]
TYPE_RANK = {"syrup": 0, "milk": 1}          # any other type ranks 2
ALLOWED_TEMPS = ["Hot", "Cold"]              # canonical order
DEFAULT_TEMPS = ["Hot"]
# seed preference order used by the rank backfill; unlisted items rank 99
SEED_RANK = {
    "Whole milk": 0, "Almond milk": 1, "Oat milk": 2, "Soy milk": 3,
    "Caramel": 0, "Sugar Free Caramel": 1, "Vanilla": 2, "Sugar Free Vanilla": 3,
    "Mocha": 4, "White Chocolate": 5, "Honey": 6, "Cinnamon Powder": 7, "Hazelnut": 8,
}
UNLISTED_RANK = 99

# --- fixed values: limits and models -------------------------------------
MAX_SYRUPS = 2
TOP_K = 5
READY_STRIP = 8
READY_STRIP_NAMES = 4
BOARD_ROWS = 14
ARCHIVE_DEFAULT = 25
ARCHIVE_MIN, ARCHIVE_MAX = 1, 50
MINUTES_PER_ORDER = 4
RETENTION_DAYS = 30
ID_MAX, LABEL_MAX, DESC_MAX = 80, 80, 180
SHOP_TZ = "America/Los_Angeles"

# --- fixed values: texts --------------------------------------------------
NOTIFY_TITLE = "Order ready"          # default; the shop passes its own name (ready_message(title=...))
READY_BODY_NAMED = "{name}, your order is ready. Please go to the kitchen."
READY_BODY = "Your order is ready. Please go to the kitchen."
ERR_DRINK = "That drink is not available today"
ERR_NAME_BLANK = "Please enter your name"
ERR_NAME_SHORT = "Please enter first and last name"
ERR_MILK_MISSING = "Please choose a milk"
ERR_OUT_OF_STOCK = "{item} is out of stock"
ERR_QUEUE_CLOSED = "Queue closed"
ERR_SAVED_DRINK = "That saved drink is not on today's menu."
LABEL_MAKING = "Being made"
LABEL_READY = "Ready for pickup"
LABEL_WAITING = "Waiting"
GUEST = "Guest"
