"""Words of product texts, Chinese to English, in the order in which words of equal length are replaced."""

#: Product fields, materials, colours, companies, certificates, dates, batteries and electrics, measures,
#: times, trade, attributes. Words of one trade (vehicles, furniture) come from a table of the caller's (word_table).
WORDS = {
    "型号": "Model", "名称": "Name", "品名": "Product Name", "产品名称": "Product Name", "规格": "Specification", "规格参数": "Specifications", "参数": "Parameters",
    "价格": "Price", "单价": "Unit Price", "人民币": "RMB", "产地": "Origin", "品牌": "Brand", "材质": "Material", "铝合金": "Aluminum Alloy", "铝合金框": "Aluminum Alloy Frame",
    "不锈钢": "Stainless Steel", "碳钢": "Carbon Steel", "塑料": "Plastic", "橡胶": "Rubber", "硅胶": "Silicone", "玻璃": "Glass", "木材": "Wood", "皮革": "Leather",
    "面料": "Fabric", "金属": "Metal", "铁": "Iron", "铜": "Copper", "铝": "Aluminum", "颜色": "Color", "红色": "Red", "蓝色": "Blue", "绿色": "Green", "白色": "White",
    "黑色": "Black", "灰色": "Gray", "黄色": "Yellow", "橙色": "Orange", "银色": "Silver", "金色": "Gold", "尺寸": "Size", "外形尺寸": "Overall Dimension", "重量": "Weight",
    "包装": "Packaging", "包装方式": "Packaging", "箱规": "Carton Size", "数量": "Quantity", "备注": "Remarks", "描述": "Description", "产品描述": "Description", "说明": "Note", "配置": "Configuration",
    "公司": "Company", "公司名称": "Company Name", "联系人": "Contact", "电话": "Tel", "邮箱": "Email", "地址": "Address", "传真": "Fax", "网址": "Website", "供应商": "Supplier",
    "生产商": "Manufacturer", "制造商": "Manufacturer", "客户": "Customer",
    "CE": "CE", "FDA": "FDA", "ISO": "ISO", "认证": "Certification", "证书": "Certificate",
    "日期": "Date", "编号": "No.", "序号": "No.", "优惠": "Discount",
    "电池": "Battery", "锂电池": "Lithium Battery", "铅酸电池": "Lead-Acid Battery", "磷酸铁锂电池": "LiFePO4 Battery", "电池类型": "Battery Type", "电池容量": "Battery Capacity",
    "电压": "Voltage", "额定电压": "Rated Voltage", "工作电压": "Working Voltage", "充电电压": "Charging Voltage", "电流": "Current", "充电电流": "Charging Current", "工作电流": "Working Current",
    "功率": "Power", "额定功率": "Rated Power", "最大功率": "Max Power", "峰值功率": "Peak Power", "电机功率": "Motor Power", "容量": "Capacity", "充电器": "Charger", "充电时间": "Charging Time",
    "续航": "Range", "续航里程": "Mileage Range", "电机": "Motor", "电机类型": "Motor Type", "无刷电机": "Brushless Motor", "轮毂电机": "Hub Motor", "中置电机": "Mid Drive Motor",
    "控制器": "Controller", "频率": "Frequency", "扭矩": "Torque", "转速": "RPM",
    "毫米": "mm", "厘米": "cm", "分米": "dm", "米": "m", "千米": "km", "英寸": "inch", "英尺": "ft", "千克": "kg", "公斤": "kg", "克": "g", "毫克": "mg", "吨": "ton", "磅": "lb",
    "盎司": "oz", "升": "L", "毫升": "ml", "加仑": "gal", "伏": "V", "安": "A", "毫安": "mA", "瓦": "W", "千瓦": "kW", "千瓦时": "kWh", "毫安时": "mAh", "安时": "Ah", "瓦时": "Wh",
    "赫兹": "Hz", "牛米": "N.m", "千米/小时": "km/h", "公里/小时": "km/h", "度": "°",
    "年": "Year", "月": "Month", "星期": "Week", "天": "Day", "小时": "h", "分钟": "min", "秒": "s",
    "FOB价格": "FOB Price", "FOB 价格": "FOB Price", "出厂价": "EXW Price", "EXW价格": "EXW Price", "成本价": "Cost Price", "批发价": "Wholesale Price", "零售价": "Retail Price",
    "总价": "Total Amount", "总金额": "Total Amount", "小计": "Subtotal", "付款": "Payment", "付款方式": "Payment Terms", "发货": "Delivery", "运输": "Shipping", "海运": "Sea Freight",
    "空运": "Air Freight", "陆运": "Land Transport", "毛重": "Gross Weight", "净重": "Net Weight", "库存": "Stock", "现货": "In Stock", "定制": "Customized", "样品": "Sample",
    "样品费": "Sample Fee", "定金": "Deposit", "尾款": "Balance Payment", "港口": "Port", "装运港": "Port of Loading", "交期": "Lead Time", "交货期": "Delivery Time",
    "生产周期": "Production Time", "贸易条款": "Trade Terms", "有效期": "Validity",
    "是": "Yes", "否": "No", "有": "With", "无": "Without", "含": "Including", "不含": "Excluding", "标准": "Standard", "可选": "Optional", "防水": "Waterproof", "防尘": "Dustproof",
    "智能": "Smart", "电动": "Electric", "自动": "Automatic", "手动": "Manual", "单速": "Single Speed", "变速": "Variable Speed", "前进": "Forward", "后退": "Reverse", "高": "Height",
    "中": "Medium", "低": "Low", "大": "Large", "小": "Small", "长": "Length", "宽": "Width", "厚": "Thickness", "直径": "Diameter", "输入": "Input", "输出": "Output",
    "最大": "Max", "最小": "Min", "额定": "Rated", "平均": "Average",
}
