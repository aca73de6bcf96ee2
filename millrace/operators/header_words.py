"""Fixed values of the sheet reader: header words by role, words and patterns of lines that are no products. Callers may
pass lists of their own."""

from __future__ import annotations

#: Header words by role. A header has a role if it holds one of its words. Roles are asked in this order.
ROLES: dict[str, tuple[str, ...]] = {
    "model": (
        "型号", "产品编号", "物料编码", "料号", "货号", "编码", "商品代码",
        "model", "part no", "p/n", "product no", "sku", "item no",
        "款号", "item code", "reference no", "product code",
        "material code", "规格型号", "品号",
        "oe no", "oem no", "replacement no",
        "catalog no", "style no", "style#",
    ),
    "spec": (
        "规格", "spec", "specification", "参数", "尺寸", "材质", "配置",
        "description", "描述", "specifications",
        "颜色", "color", "size", "尺码", "面料", "成分",
        "material", "dimension", "功率", "voltage", "capacity",
        "purity", "纯度", "含量", "浓度", "concentration",
        "surface", "finish", "工艺", "表面处理",
        "色温", "流明", "lumens", "灯头", "显指",
        "适用车型", "application", "适用年龄", "age range",
        "容量", "current", "频率", "frequency",
        "产品说明", "detail", "details", "参数表", "技术参数",
        "产品参数", "性能参数", "规格参数", "主要规格", "technical specification",
    ),
    "name": (
        "产品名称", "产品名", "品名", "名称", "商品名", "产品", "product",
        "name", "项目", "物料名称", "货物名称",
        "品名规格", "商品名称", "产品描述", "物料描述",
        "item description", "goods name", "article name",
        "produit", "produkt", "descripción", "descrizione",
        "produto", "naam", "produktname", "productnaam", "designation",
    ),
    "price": (
        "价格", "单价", "出厂价", "系统价格", "成本价", "成本", "报价", "金额", "含税",
        "exw", "fob", "cif", "批发价", "市场价", "零售价",
        "price", "cost", "rmb", "总价", "总金额", "subtotal",
        "成交价", "到厂价", "unit price", "selling price", "export price",
        "fca", "ddp", "cpt", "cip", "c&f", "cfr",
        "退税", "含税价", "不含税",
    ),
    "qty": (
        "数量", "订货量", "起订量", "qty", "quantity",
        "pcs", "sets", "pair", "件", "套", "双",
        "pack qty", "数量/箱", "装箱数", "每箱数量",
        "净含量", "net weight", "n.w.", "每箱", "pcs/ctn",
        "moq", "minimum order", "最小起订量", "最低订购量",
        "min order qty", "min order", "最少订货", "最少起订",
    ),
    "packing": (
        "包装", "内盒", "外箱", "每箱", "packing", "package", "装箱明细", "packing list",
        "carton size", "测量", "meas", "cbm", "体积", "外箱尺寸",
        "carton", "ctn", "箱规", "装箱", "pack qty", "每箱数量", "qty/ctn", "pcs/ctn",
        "每箱重量", "体积重", "包装尺寸", "packing size",
        "重量", "weight", "g.w.", "n.w.", "净重", "毛重",
        "gross weight", "net weight", "dimension", "measurement",
        "units per carton", "carton weight",
    ),
    "category": ("类别", "产别", "type", "种类", "分类", "category", "grade", "等级"),
    "remark": ("备注", "remark", "remarks", "条款", "note", "说明", "附注"),
    "brand": ("brand", "品牌", "manufacturer", "制造商", "supplier", "厂家", "供应商", "厂商", "maker", "producer", "牌子", "商标", "trademark"),
    "cert": (
        "certification", "cert", "认证", "ce", "fcc", "rohs", "reach",
        "fda", "iso", "ul", "ccc", "sgs", "证书", "standard", "标准",
        "approval", "approved", "compliant", "compliance", "达标",
    ),
    "hscode": ("hs code", "hs编码", "hts", "tariff code", "customs code", "海关编码", "税号", "h.s.code", "h.s. code", "tariff no", "hs no", "hs number"),
    "lead_time": ("lead time", "delivery time", "交货期", "交期", "货期", "出货时间", "delivery date", "delivery schedule", "leadtime", "ship date", "shipment date"),
    "warranty": ("warranty", "保修", "质保期", "保质期", "guarantee", "warranty period", "保修期", "保质", "质保", "售后服务"),
    "barcode": ("barcode", "bar code", "ean", "upc", "gtin", "条形码", "条码", "ean13", "ean-13", "upc-a", "upc-e", "商品条码", "ean code"),
    "origin": ("origin", "country of origin", "原产地", "产地", "made in", "country", "国家", "origin country", "来源地", "生产地"),
}

#: A header that holds a strong word for specifications and none for models is no model column.
STRONG_SPEC = ("specification", "specifications", "规格型号", "参数", "description")
STRONG_MODEL = ("型号", "物料编码", "料号", "货号", "product no", "part no", "p/n", "sku", "item no", "产品编号")

#: Cells that are a header word as a whole.
HEADER_WORDS = (
    "产品名称", "产品名", "品名", "名称", "name", "product",
    "价格", "单价", "price", "规格", "spec", "型号", "model",
    "编码", "qty", "数量", "包装", "备注", "尺寸", "照片", "图片",
    "款号", "货号", "色号", "sku", "item no",
    "颜色", "color", "材质", "material", "面料",
    "功率", "voltage", "capacity",
    "cost", "rmb", "fob", "cif", "exw",
    "等级", "grade", "类别", "category",
    "箱规", "装箱", "carton", "每箱", "packing", "cbm",
)
#: Words of a header within a cell.
HEADER_PARTS = ("model", "name", "price", "spec", "qty", "规格", "型号")
#: Words of prices.
PRICE_WORDS = (
    "价格", "单价", "出厂价", "系统价格", "成本价", "成本", "报价", "金额", "含税",
    "exw", "fob", "cif", "批发价", "市场价", "零售价",
    "price", "cost", "rmb", "总价", "总金额", "subtotal",
    "成交价", "到厂价", "unit price", "selling price", "export price",
    "fca", "ddp", "cpt", "cip", "c&f", "cfr",
    "退税", "含税价", "不含税", "usd", "$", "cny", "¥",
)
#: Headers of columns that are never read.
SKIPPED = ("serial no", "sr.no", "serial", "image", "picture", "photo", "序号", "图片", "照片")

#: Patterns of lines that are no products.
NON_PRODUCT = (
    r"^(contract|seller|buyer|payment|shipping|delivery|transshipment|remarks?|note|terms|conditions?|address|tel[.:\s]|fax[.:\s]|email|phone|website|bank|account|beneficiary|swift|contact|signature|date|invoice|validity|description)",
    r"^(total\s+amount|total\s+payment|grand\s+total|sub\s*total|total\s*[:：]|总计金额|合计金额)",
    r"^\d+[.、\s]\s*(transshipment|payment|delivery|packing|insurance|bank|inspection|arbitration|force\s*majeure|shipping|terms?|conditions?|warranty|validity|quality|port|brand|motorcycle|e[\-\s]?bike|destination|notice|handling)",
    r"^(合同|卖方|买方|付款|交货|运输|包装|条款|备注|说明|地址|电话|邮箱|日期|受益|银行|账户|签名|签字|合计|总计|金额|小计|编号|序号)",
    r"^(¥|\$|eur|usd|cny)\s*[\d,]+",
    r"^(company|supplier|customer|buyer|seller)(\s|$)",
    r"^\d+[.、]\s*[（(]?\s*(本合|支付|交[货付]|运[输送]|包[装]|条[款]|备[注]|说[明]|地[址]|电[话]|日[期]|银[行]|账[户]|签[名字]|仲裁|保险)",
    r"^(proforma\s+invoice|sales\s+contract|to\s*:|the\s+(seller|buyer)|sign(ed|ature)|date\s+of\s+)",
    r"^total\s+payment",
    r"^\d+[.、]\s*(port\s+of|brand\s+name|handling\s+method|other\s+notices|motorcycle\s+brand)",
    r"^(\(signed|\(stamp|\(seal|signature\s+by|authorized\s+sign)",
    r"^(sign(ed|ature)?|approv(ed|al)?|authoriz(ed|ation)?|seal|stamp|公章|签字|签名|盖章|审批)",
    r"^(contract\s*no|order\s*no|po\s*no|invoice\s*no|ref\s*no|payment\s*no|shipment\s*no|delivery\s*no|doc\s*no|quotation\s*no|quote\s*no)\s*[:\-.]?\s*[\w\-]+",
    r"^(PO|SO|CO|DO|WO|IV|INV|CT|CN|QT|RFQ|PI|DN|GRN)[\d\-]{8,20}$",
    r"^(packing\s*(list|detail|info)|装箱(单|明细|清单))",
    r"^(notify\s+party|consignee|carrier|forwarder|agent)",
    r"^(test\s+report|inspection\s+report|certificate\s+of)",
    r"^(unit\s+(of|in)|uom|计量单位|单位[：:])",
    r"^(country\s+of\s+origin|made\s+in|原产地|manufacturer)",
    r"^(仲裁|保险|商检|产地证|原产地|信用证|l/?c|t/?t|不可抗力)",
    r"^(产品_r\d+|商品_×\d+)$",
)
#: Patterns of document lines in a first cell.
DOCUMENT_LINES = (
    r"^(contract|order|po|p\.?o\.?|invoice|quote|ref|reference|date|payment|delivery|shipment|document|doc)(\s*(no|#|number|\.?))?\s*[:\-\.]?\s*[\w\-\d]+",
    r"^(contract\s*no|order\s*no|po\s*no|invoice\s*no|ref\s*no|reference\s*no|doc\s*no|payment\s*no|shipment\s*no|delivery\s*no)",
    r"^(合同编号|订单编号|订单号|发票号|参考号|文档号|付款编号|运输编号)",
    r"^(date|dates?)\s*[:\-\.]?\s*[\d\-\/]+",
    r"^(payment|delivery|shipment|shipping|port\s+of|discharge|loading)\s",
    r"^(seller|buyer|supplier|customer|consignee|notify\s+party)\s*[:\-]",
    r"^(marks?\s*(&|\s*no|\s*#)|shipping\s*mark|container\s*(no|#))",
    r"^(proforma|commercial)\s+(invoice|inv)",
    r"^(certificate\s+of|origin\s+certificate|fumigation|inspection\s+(report|cert))",
    r"^(卖方|买方|供应商|客户|收货人|通知方|承运人)",
    r"^\d+[.、\s]\s*(transshipment|payment|delivery|packing|insurance|bank|inspection|arbitration|force\s*majeure|shipping|terms?|conditions?|warranty|validity|quality|port|brand|motorcycle|e[\-\s]?bike|destination|notice|handling)",
    r"^(仲裁|保险|商检|产地|原产|信用证|l/?c|t/?t|不可抗力)",
    r"^(total\s+amount|total\s+payment|grand\s+total|总计金额|合计金额|total\s*[:：])",
    r"^(sign(ed|ature)?|approv(ed|al)?|authoriz(ed|ation)?|seal|stamp|公章|签字|签名|盖章|审批)",
    r"^(packing\s*(list|detail|info)|装箱(单|明细|清单)|mark\s*(nos?|#))",
)
#: Fixed value: order numbers, which look like models.
ORDER_NUMBER = r"^(PO|SO|CO|DO|WO|IV|INV|CT|CN|QT|RFQ|PI|DN|GRN)[\d\-]{6,15}$"
#: Words within a first cell without price and quantity that speak against a product.
SKIP_WORDS = (
    "条款", "备注", "说明", "合计", "total", "subtotal",
    "小计", "汇总", "总计",
    "报关", "合同", "header", "price term", "warranty", "oem", "validity",
    "shipment", "delivery", "payment", "信用证", "l/c", "t/t",
    "唛头", "mark", "shipping mark",
    "检验", "inspection", "test", "质检", "quality report",
    "有效期", "offer valid", "valid until",
    "contract", "po", "order",
    "loading", "discharge", "port",
    "customized", "定制", "logo",
    "包邮", "执行", "经销价",
    "件以下", "件起", "非偏远",
    "系统价格", "零售价", "批发价",
    "不含税", "含税价",
    "偏远地区",
    "total amount", "grand total", "总计金额", "合计金额",
)
#: Headers by which a column has its role, asked in this order; those of three signs or fewer must stand alone.
HEAD_ROLES = {
    "price": ("price", "unit price", "单价", "价格", "售价", "报价", "fob", "exw", "cif", "($)", "(¥)", "(rmb)", "(usd)", "(cny)"),
    "qty": ("qty", "quantity", "数量", "件数", "moq", "min order", "起订量", "最小起订量", "packing quantity"),
    "model": ("model", "型号", "规格型号", "product name", "产品名称", "product code", "产品型号", "item no", "item #"),
    "spec": ("spec", "specification", "规格", "description", "描述", "材质", "尺寸", "参数"),
    "packaging": ("carton", "包装", "装箱", "毛重", "净重", "尺寸", "cbm", "capacity", "box size", "carton size", "shipping", "estimate"),
    "skip": ("photo", "image", "picture", "图片", "no.", "#", "序号"),
}
#: Parts of headers of columns that are skipped; words of packaging columns; what their cells hold; labels.
SKIPPED_COLUMNS = ("serial", "no.", "no", "序号", "序號", "image", "picture", "photo", "图片", "圖片", "照片", "附图", "附圖")
PACKAGING_WORDS = (
    "gw", "nw", "g.w.", "n.w.", "gross weight", "net weight", "gross", "net", "carton size", "carton", "package size", "packing size", "packing", "cbm", "meas", "measurement",
    "dimension", "dimensions", "qty/ctn", "pcs/ctn", "qty per carton", "毛重", "净重", "外箱尺寸", "包装尺寸", "每箱数量", "装箱", "体积", "包装", "cartons", "ctns", "units per carton", "n.w", "g.w",
)
PACKAGING_CONTENT = ("pcs/", "pcs/pack", "pcs/box", "pack", "pieces", "个/箱", "个/包", "只/箱", "装箱")
LABELS = ("image", "picture", "photo", "description", "name", "规格", "参数", "颜色", "材料", "备注")
