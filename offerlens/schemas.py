"""Schemas of the tables."""

LISTING = (
    "id string, name string, price_euro double, source string, url string, image_url string, "
    "in_stock boolean, ean string, sku string, brand string"
)
LISTINGS = f"query_id string, arrival long, {LISTING}, scraped_at timestamp"
PAYLOADS = "source string, kind string, request_key string, status int, final_url string, headers map<string,string>, body string"
PRICE_HISTORY = "seq long, product_id string, source string, price_euro double, in_stock boolean, recorded_at timestamp"
SOURCES = "rank int, id string, name string, domain string, origin string, search boolean, product_lookup boolean, ean_in_search boolean, page_cap int, transport string, disallowed boolean, notes string"
