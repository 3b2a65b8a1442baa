"""They must equal the data and the target platform's contract.

Legacy column names, status names, labels, upload headings and request paths are
facts about the two stores, so they are listed here as plain text. Besides, only the test
values and the SQL that checks the results spell some of them.
"""

# Migration batches.
PHASES = ("first", "second", "third", "fourth", "fifth")

# Legacy order columns -> names used in this package. The column that
# holds the new platform's order id has no legacy name; readers take it as an argument.
ORDER_LINE_COLUMNS = {
    "交易平台": "platform",
    "交易序號": "transaction_no",
    "交易平台交易序號": "order_uid",
    "訂單編號": "line_order_no",
    "商品編號": "item_code",
    "商品資訊": "item_name",
    "商品單價": "unit_price",
    "小計數量": "quantity",
    "商品小計": "items_subtotal",
    "交易金額": "order_total",
    "折扣總額": "discount_total",
    "運費": "shipping_fee",
    "建立時間": "created_at",
    "訂單狀態": "order_status",
    "付款資訊": "payment_info",
    "付款日期": "paid_at",
    "配貨時間": "allocated_at",
    "配送狀態": "delivery_state",
    "出貨類型": "delivery_type",
    "出貨日期": "shipped_at",
    "店家備註": "shop_note",
    "取消原因": "cancel_reason",
    "買家備註": "buyer_note",
    "出貨備註": "delivery_note",
    "收件者姓名": "recipient_name",
    "收件者手機": "recipient_phone",
    "收件者手機無0": "recipient_phone_no0",
    "收件者縣市": "recipient_city",
    "收件者地址": "recipient_address",
    "郵遞區號": "postcode",
    "會員帳號": "customer_email",
}

# Legacy customer columns.
CUSTOMER_COLUMNS = {
    "姓名": "name",
    "會員帳號": "email",
    "電話": "phone",
    "生日": "birthday",
    "會員備註": "note",
    "紅利點數": "points",
    "購物金": "credits",
    "地址": "address",
    "會員等級": "tier",
}

# The platform's customer export.
PLATFORM_CUSTOMER_COLUMNS = {
    "顧客ID": "customer_id",
    "電郵": "email",
    "現有購物金": "credits",
    "現有點數": "points",
}

# Legacy product columns; the stock heading differs in the CSV file.
PRODUCT_COLUMNS = {
    "商品編號": "code",
    "商品名稱": "name",
    "樣式": "style",
    "尺寸": "size",
    "實際庫存": "stock",
    "售價": "price",
}
PRODUCT_CSV_STOCK_HEADING = "實際庫存(可用庫存+配貨)"

# Customer rules.
DEFAULT_CUSTOMER_NAME = "使用者"
CALLING_CODE = "886"
MEMBER_FLAG = "Y"
COUNTRY_CODE = "TW"
CUSTOMER_NOTE_PREFIX = "舊站-會員備註-"
CUSTOMER_TIER_TAG_PREFIX = "舊站-會員級別-"
CUSTOMER_LIST_END = ","
PHONE_NOTE_PREFIX = "舊站電話-"
SENTENCE_END = "。"
PICKUP_SHOP_MARK = "門市"
COUNTY_MARK = "縣"
CITY_MARK = "市"
CITY_MARK_LOOKALIKE = "巿"
CITY_NAME_LENGTH = 3
BIRTHDAY_CUTOFF = "2011-01-01"
MOBILE_LENGTH = 10
MOBILE_PREFIX = "09"
STANDARD_TIER = "一般"
TIER_TAG_PREFIX = "0325-"

# Order rules.
PHONE_RESTORE_YEAR = "2023"
DUPLICATE_YEAR = 2023
DUPLICATE_MONTHS = (1, 6)
CLOSED_ACCOUNT_MARK = "註銷本帳號"
PLACEHOLDER_EMAIL = "fakeUser@gmail.com"
PLACEHOLDER_PHONE = "0000000000"
UNCHOSEN_DELIVERY = "尚未選擇"
RECOVERY_PLATFORM = "USHOP"

# Order document items.
PRODUCT_ITEM = "CustomProduct"
DISCOUNT_ITEM = "CustomDiscount"
BALANCE_NAME = "差額"
SHIPPING_NAME = "運費"
DISCOUNT_NAME = "折扣及紅利點數"
MARKER_PREFIX = "舊站訂單-"
VARIANT_SPECIFICATION = "規格"

# Order remark, column -> label, in document order.
REMARK_LABELS = {
    "shop_note": "店家備註",
    "cancel_reason": "取消原因",
    "buyer_note": "買家備註",
    "delivery_note": "出貨備註",
    "created_at": "建立時間",
    "order_status": "訂單狀態",
    "payment_info": "付款資訊",
    "paid_at": "付款日期",
    "allocated_at": "配貨時間",
    "delivery_state": "配送狀態",
    "delivery_type": "出貨類型",
}

# Legacy order states and the platform states they become.
FINISHED = "交易終結"
CANCELLED = "已取消"
ORDER_STATUS = {
    "交易終結": "completed",
    "出貨中": "confirmed",
    "已出貨": "confirmed",
    "已取消": "cancelled",
    "新訂單": "pending",
}
DELIVERY_STATUS = {
    "交易終結": "arrived",
    "出貨中": "shipping",
    "已出貨": "shipped",
    "新訂單": "pending",
}

# Request contract of the platform ({} is the entity's id).
CREATE_ORDER_PATH = "/orders"
ORDER_STATUS_PATH = "/orders/{}/status"
PAYMENT_STATUS_PATH = "/orders/{}/order_payment_status"
DELIVERY_STATUS_PATH = "/orders/{}/order_delivery_status"
CANCEL_ORDER_PATH = "/orders/{}/cancel"
POINTS_PATH = "/customers/{}/member_points"
CREDITS_PATH = "/customers/{}/store_credits"
TAGS_PATH = "/customers/{}/tags"
CUSTOMER_PATH = "/customers/{}"
POINTS_REMARK = "舊站點數"
CREDITS_REMARK = "搬站"
DO_NOT_NOTIFY = 1
TAG_MODE = "add"
CANCEL_REASON_KEY = "other"
CANCEL_REASON_TEXT = "刪除測試商店訂單"
UNPROCESSABLE = 422

# Export sizes.
ROWS_PER_PAGE = 3000
CSV_EXPORT_ROWS = 100

# Target customer column -> upload heading, in file order.
UPLOAD_HEADINGS = {
    "full_name": "Full Name",
    "email_address": "Email Address",
    "country_calling_code": "Country Calling Code",
    "mobile_number": "Mobile Number",
    "gender": "Gender",
    "birthday": "Birthday",
    "language": "Language",
    "is_member": "Is Member",
    "accepts_marketing": "Accepts Marketing",
    "tags": "Tags",
    "note": "Note",
    "register_from": "Register From",
    "register_store_id": "Register Store ID",
    "register_date": "Register Date",
    "total_spend": "Total Spend",
    "order_is_accumulation": "Order Is Accumulation",
    "membership_tier": "Membership Tier",
    "store_credits": "Store Credits",
    "reason_for_adding_credits": "Reason for adding Credits",
    "expiry_date_of_credits": "Expiry Date of Credits",
    "member_points": "Member Points",
    "reason_for_adding_points": "Reason for adding Points",
    "country_calling_code_of_contact_phone": "Country Calling Code of Contact Phone",
    "contact_phone": "Contact Phone",
    "address_recipient_name": "Address - Recipient Name",
    "address_country_calling_code_of_recipient_phone_number":
        "Address - Country Calling Code of Recipient Phone Number",
    "address_recipient_phone_number": "Address - Recipient Phone Number",
    "address_1": "Address - 1",
    "address_2": "Address - 2",
    "address_city": "Address - City",
    "address_district_state_province": "Address - District/State/Province",
    "address_postcode": "Address - Postcode",
    "address_country": "Address - Country",
}
# Kept in the table, never uploaded.
ORIGINAL_ADDRESS = "original_address"

# Target customer columns that are not text.
TARGET_CUSTOMER_TYPES = {
    "birthday": "date",
    "total_spend": "decimal(18,4)",
    "order_is_accumulation": "boolean",
    "store_credits": "int",
    "expiry_date_of_credits": "date",
    "member_points": "int",
}

# Longest texts the target customer table takes; 20 where not listed.
TARGET_CUSTOMER_LENGTHS = {
    "full_name": 100,
    "email_address": 255,
    "mobile_number": 255,
    "contact_phone": 100,
    "address_recipient_name": 100,
    "address_recipient_phone_number": 100,
    "address_1": 255,
    "address_2": 255,
    "original_address": 255,
}
TARGET_CUSTOMER_LENGTH = 20
# Target customer texts of any length.
TARGET_CUSTOMER_LONG_TEXTS = ("tags", "note")

# Target product columns, in table order.
TARGET_PRODUCT_COLUMNS = (
    "product_handle",
    "product_name_english",
    "product_name_chinese",
    "product_summary_english",
    "product_summary_chinese",
    "product_description_english",
    "product_description_chinese",
    "seo_title_english",
    "seo_title_chinese",
    "seo_description_english",
    "seo_description_chinese",
    "seo_keywords",
    "preorder_item",
    "preorder_note_english",
    "preorder_note_chinese",
    "online_store_status",
    "retail_store_status",
    "images",
    "additional_images",
    "online_store_categories_english",
    "online_store_categories_chinese",
    "pos_categories_english",
    "pos_categories_chinese",
    "price",
    "sales_price",
    "product_retail_store_price",
    "cost",
    "sku",
    "member_price",
    "level_1_price",
    "level_2_price",
    "level_3_price",
    "quantity",
    "weight_kg",
    "supplier",
    "product_tag",
    "hidden_product",
    "specification_name_a_english",
    "specification_name_a_chinese",
    "specification_name_b_english",
    "specification_name_b_chinese",
    "variation_image",
    "variation_name_a_english",
    "variation_name_a_chinese",
    "variation_name_b_english",
    "variation_name_b_chinese",
    "variation_quantity",
    "variation_price",
    "variant_sale_price",
    "variant_retail_store_price",
    "variant_member_price",
    "variant_level_1_price",
    "variant_level_2_price",
    "variant_level_3_price",
    "variant_cost",
    "variation_sku",
    "variant_weight_kg",
    "barcode",
)
# Target product columns that are not text.
TARGET_PRODUCT_TYPES = {
    "preorder_item": "boolean",
    "online_store_status": "boolean",
    "retail_store_status": "boolean",
    "price": "decimal(18,4)",
    "sales_price": "decimal(18,4)",
    "product_retail_store_price": "decimal(18,4)",
    "cost": "decimal(18,4)",
    "quantity": "int",
    "hidden_product": "boolean",
    "variation_quantity": "int",
    "variation_price": "decimal(18,4)",
    "variant_sale_price": "decimal(18,4)",
    "variant_retail_store_price": "decimal(18,4)",
    "variant_cost": "decimal(18,4)",
    "variant_weight_kg": "decimal(18,4)",
}
