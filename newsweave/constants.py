"""Word lists, patterns and sources that results depend on, stated as they are."""

from __future__ import annotations

# fixed values: news feeds, in scanning order
FEEDS = [
    "https://vnexpress.net/rss/suc-khoe.rss",
    "https://dantri.com.vn/rss/suc-khoe.rss",
    "https://tuoitre.vn/rss/suc-khoe.rss",
    "https://thanhnien.vn/rss/suc-khoe.rss",
    "https://suckhoedoisong.vn/rss/suc-khoe.rss",
    "https://vov.vn/rss/suc-khoe.rss",
    "https://tienphong.vn/rss/suc-khoe-210.rss",
    "https://laodong.vn/rss/suc-khoe.rss",
    "https://vietnamnet.vn/rss/suc-khoe.rss",
    "https://nhandan.vn/rss/y-te.rss",
    "http://cand.com.vn/rss/suc-khoe-c-5",
]

# fixed values: phrases of advice and small talk that rule a title out
EXCLUDED = ["tư vấn", "hỏi đáp", "lời khuyên", "có nên", "thực phẩm chức năng", "giảm cân", "làm đẹp", "bí quyết", "mẹo", "ăn gì", "uống gì"]

# fixed values: phrases that make a title an alert
ALERTS = ["bùng phát", "ổ dịch", "khẩn cấp", "tử vong", "nguy kịch", "lây lan nhanh"]

# fixed values: domains trusted where none are stored
TRUSTED = ["vnexpress.net", "dantri.com.vn", "tuoitre.vn", "thanhnien.vn", "suckhoedoisong.vn", "tienphong.vn", "laodong.vn", "vietnamnet.vn", "nhandan.vn", "cand.com.vn"]

# fixed values: case counts in lower-cased text, the first pattern before the second
CASES_BEFORE_NOUN = r"(\d+)\s+(ca\s+mắc|trường\s+hợp|người\s+nhiễm|ca\s+dương\s+tính)"
CASES_AFTER_VERB = r"(phát\s+hiện|ghi\s+nhận)\s+(\d+)\s+(ca|trường\s+hợp)"

# fixed values: tags and the location of every case
TAG_NEW, TAG_ALERT, LOCATION = "Mới", "Cảnh báo", "Việt Nam"
#: labels of a found article, and the line after it
REPORT_DATE, REPORT_LINK, REPORT_SUMMARY, REPORT_LINE = "Ngày: ", "Link: ", "Tóm tắt: ", "-" * 80
NO_TREND = "Chưa có data"

# fixed values: named keyword sets of the search, comma-separated
KEYWORD_SETS = {
    "sebs": (
        "Bại liệt, cúm gia cầm, dịch hạch, đậu mùa, bệnh tả, tay chân miệng, sốt phát ban, sởi, sốt xuất huyết, bạch hầu, ho gà, viêm não nhật bản, "
        "viêm não vi rút, thủy đậu, cúm A, cúm B, cúm mùa, não mô cầu, bệnh lạ, viêm phổi nặng, bệnh mới nổi, chưa rõ tác nhân gây bệnh, bùng phát ca bệnh, "
        "gia tăng số ca bệnh, gia tăng số lượng người nhập viện, hàng loạt ca bệnh, ổ dịch, vụ dịch, phản ứng nặng sau tiêm vắc xin, tử vong do bệnh truyền nhiễm, "
        "tử vong không rõ nguyên nhân, tử vong sau tiêm vắc xin, động vật ốm chết hàng loạt, gia cầm ốm chết, unknown disease, emerging disease, re-emerging disease, "
        "reemerging disease, avian influenza, H5N1, Bird Flu, Ebola, MERS, public health emergency, pandemic threat"
    ),
    "sgain": (
        "ChatGPT, OpenAI, trí tuệ nhân tạo sinh, GPT-4, học máy, chatbot, đạo đức trí tuệ nhân tạo, trợ lý ảo, học sâu, mạng nơ-ron, xử lý ngôn ngữ tự nhiên, DALL-E, "
        "công cụ trí tuệ nhân tạo, đổi mới trí tuệ nhân tạo, mô hình trí tuệ nhân tạo, Grok, Google Brain, tạo sinh văn bản, nội dung trí tuệ nhân tạo, "
        "vận hành bởi trí tuệ nhân tạo, ứng dụng trí tuệ nhân tạo, ngành công nghiệp trí tuệ nhân tạo, công nghệ trò chuyện, nhận diện giọng nói, "
        "nghiên cứu trí tuệ nhân tạo, cập nhật trí tuệ nhân tạo, mô hình transformer, học tăng cường, sáng tạo trí tuệ nhân tạo, quy định trí tuệ nhân tạo, "
        "quản trị trí tuệ nhân tạo, giáo dục trí tuệ nhân tạo, trí tuệ nhân tạo trong y tế, trí tuệ nhân tạo trong tài chính, an toàn trí tuệ nhân tạo, tạo sinh hình ảnh, "
        "mô hình ngôn ngữ, trí tuệ nhân tạo hội thoại, phương tiện tổng hợp, trí tuệ nhân tạo tương tác, doanh nghiệp trí tuệ nhân tạo, giải pháp trí tuệ nhân tạo, "
        "phát triển trí tuệ nhân tạo, tự động hóa trí tuệ nhân tạo, trò chuyện trí tuệ nhân tạo, ngôn ngữ trí tuệ nhân tạo, trí tuệ nhân tạo tự trị, "
        "mô hình ngôn ngữ lớn, bots trí tuệ nhân tạo, tiến bộ trí tuệ nhân tạo, triển khai trí tuệ nhân tạo, trí tuệ nhân tạo"
    ),
}

# fixed values: hours from UTC of zone names in dates; summer names have their own offset
ZONES = {
    "UTC": "+00:00", "EDT": "-04:00", "EST": "-05:00", "PDT": "-07:00", "PST": "-08:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00",
    "BST": "+01:00", "GMT": "+00:00", "CET": "+01:00", "CEST": "+02:00", "ICT": "+07:00", "SGT": "+08:00", "JST": "+09:00", "IST": "+05:30",
}
