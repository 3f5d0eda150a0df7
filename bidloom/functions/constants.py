"""Fixed values of the procurement domain."""

# Abbreviations of professions and categories, and each category's profession.
PROFESSION_ABBREVIATIONS = {"电气": "EL", "给排水": "WS", "暖通": "HV", "消防": "FP", "智能化": "IT", "电梯": "EV", "幕墙": "CW", "其他": "OT"}
CATEGORY_ABBREVIATIONS = {
    "桥架": "BRG", "母线槽": "BUS", "配电箱": "PDB", "阀门": "VLV", "不锈钢管": "SSP",
    "水箱": "WTK", "潜水泵": "SMP", "风口风阀": "FAV", "风机盘管": "FCU", "空调泵": "ACP",
}
PROFESSIONS = {
    "桥架": "电气", "母线槽": "电气", "配电箱": "电气",
    "阀门": "给排水", "不锈钢管": "给排水", "水箱": "给排水", "潜水泵": "给排水",
    "风口风阀": "暖通", "风机盘管": "暖通", "空调泵": "暖通",
}
CATEGORIES = list(PROFESSIONS)

# Weights of a supplier's score, and alert bounds (yellow, red) by category.
SCORE_WEIGHTS = {"price_competitiveness": 0.40, "history_cooperation": 0.20, "quote_completeness": 0.15, "brand_compliance": 0.15, "commercial_terms": 0.10}
THRESHOLDS = {
    "default": (0.05, 0.10), "桥架": (0.08, 0.15), "母线槽": (0.06, 0.12), "配电箱": (0.08, 0.15), "阀门": (0.06, 0.12), "不锈钢管": (0.05, 0.10),
    "水箱": (0.08, 0.15), "潜水泵": (0.06, 0.12), "风口风阀": (0.07, 0.13), "风机盘管": (0.07, 0.13), "空调泵": (0.06, 0.12),
}

# Nominal diameters by inches and by outer diameter in millimetres, and those in use.
DN_BY_INCH = {"1/2": 15, "3/4": 20, "1": 25, "1.25": 32, "1.5": 40, "2": 50, "2.5": 65, "3": 80, "4": 100, "5": 125, "6": 150, "8": 200, "10": 250, "12": 300}
DN_BY_OUTER = {
    15: 15, 18: 15, 20: 15, 22: 20, 25: 20, 27: 20, 32: 25, 34: 25, 42: 32, 48: 40, 57: 50, 60: 50, 76: 65, 89: 80, 108: 100, 114: 100,
    133: 125, 140: 125, 159: 150, 168: 150, 219: 200, 273: 250, 325: 300, 377: 350, 426: 400, 480: 450, 530: 500, 630: 600,
}
DN_IN_USE = [15, 20, 25, 32, 40, 50, 65, 80, 100, 125, 150, 200, 250, 300, 350, 400, 450, 500, 600]

# Synonyms, in the order in which they are replaced. A guard keeps 线槽 inside 母线槽.
SYNONYMS = [
    ("热浸锌", "热浸镀锌"), ("冷镀锌", "电镀锌"), ("电缆桥架|线缆桥架", "桥架"), ("(?<!母)线槽|槽盒", "槽式桥架"), ("消防桥架", "防火桥架"),
    ("室外桥架", "防水桥架"), ("槽式托盘", "槽式"), ("托盘型", "托盘式"), ("蝶型阀", "蝶阀"), ("闸板阀", "闸阀"), ("逆止阀|单向阀", "止回阀"),
    ("不锈钢无缝管", "不锈钢管"), ("排污泵|污水泵", "潜水泵"), ("风机盘管机组", "风机盘管"), ("风盘", "风机盘管"),
]

# Patterns by which a header names a field, the first that fits counts.
COLUMN_PATTERNS = {
    "name": ["名称", "品名", "物料名", "设备名", "材料名"],
    "spec": ["规格型号", "规格", "型号"],
    "brand": ["品牌", "厂家", "制造商"],
    "supplier": ["供应商", "投标单位", "报价单位", "厂商名称"],
    "material_type": ["材质", "材料", "牌号"],
    "unit": ["单位", "计量"],
    "price": ["含税单价", "含税.*单价", "单价.*含税", "价税合计", "含税价", "单价"],
    "price_excl": ["不含税单价", "不含税.*单价", "单价.*不含税", "不含税价"],
    "quantity": ["数量", "工程量", "数 量"],
    "remark": ["备注", "说明", "备 注"],
    "sub_category": ["子类", "类别", "分类"],
}

# Sub-categories by pattern, the first that fits counts. An empty pattern fits
# nothing, so the one of 不锈钢管 is left out: plain pipes are 其他.
SUBCATEGORY_RULES = {
    "桥架": [("梯架|梯式", "梯式桥架"), ("槽式", "槽式桥架"), ("线槽", "线槽"), ("防水", "防水桥架"), ("竖井", "竖井桥架"), ("铝合金", "铝合金桥架"),
            ("复合|彩钢|玻璃钢", "复合桥架"), ("弱电", "弱电桥架"), ("托盘", "托盘式桥架"), ("桥架", "普通桥架")],
    "阀门": [("倒流防止", "倒流防止器"), ("水位控制", "水位控制阀"), ("排气阀", "排气阀"), ("Y.*过滤|过滤器", "过滤器"), ("止回", "止回阀"), ("球阀", "球阀"),
            ("蝶阀", "蝶阀"), ("闸阀", "闸阀"), ("减压", "减压阀"), ("平衡", "平衡阀"), ("电动", "电动阀"), ("阀", "其他阀门")],
    "风口风阀": [("消声", "消声器/静压箱"), ("静压", "消声器/静压箱"), ("防火阀|FD|MEC|MEE|FVDK", "防火阀"), ("排烟阀|BEC|BEE", "排烟阀"),
               ("调节阀|调节风阀|调节蝶阀|VD|VCD|MD|MVD", "调节阀"), ("电动.*阀|开关阀|电动风阀|FM", "电动风阀"), ("止回阀|NRD", "止回阀"), ("定风量|CAV", "定风量阀"),
               ("送风口|排烟口|正压|GF|GP|GS|PS", "送风口/排烟口"), ("格栅|AH|AV|BH", "格栅风口"), ("百叶|自垂|门铰|HH", "百叶风口"),
               ("散流器|旋流|SD|FP|条形", "散流器"), ("风口", "其他风口")],
    "母线槽": [("密集", "密集型母线槽"), ("空气", "空气型母线槽"), ("耐火", "耐火型母线槽"), ("插接箱|插接", "插接箱"), ("母线", "母线槽")],
    "不锈钢管": [("316L|316", "316/316L不锈钢管"), ("304", "304不锈钢管"), ("雨水", "不锈钢雨水管"), ("管件|弯头|三通|接头", "管件"), ("卡箍|连接", "连接件")],
    "水箱": [("消毒", "消毒器"), ("集水箱|污水", "污水集水箱"), ("水箱", "不锈钢水箱")],
    "潜水泵": [("控制柜|控制箱", "控制柜"), ("自耦|导杆|链条|浮球|电缆", "附件"), ("泵|潜水", "潜水泵")],
    "风机盘管": [("卧式", "卧式风机盘管"), ("立式", "立式风机盘管"), ("盘管", "风机盘管")],
    "空调泵": [("卧式", "卧式离心泵"), ("立式", "立式离心泵"), ("泵", "离心泵")],
    "配电箱": [("动力", "动力配电箱"), ("照明", "照明配电箱"), ("配电", "配电箱")],
}
LOST = "未中标"
JOINT_VENTURE = "合资"

# Attributes of each category beside the common ones: key, label, where it is from, whether it must match or tells apart.
EXTENDED_ATTRIBUTES = {
    "桥架": [("surface", "表面处理", "报价单/投标", "匹配"), ("thickness", "板材厚度(mm)", "报价单/投标", "差异"), ("load_type", "荷载等级", "投标/图纸", "匹配"), ("fire_rating", "防火等级", "投标/图纸", "匹配")],
    "母线槽": [("rated_current", "额定电流(A)", "报价单/投标", "匹配"), ("ip_rating", "防护等级", "投标", "匹配"), ("conductor", "导体材质", "报价单", "差异"), ("insulation", "绝缘方式", "投标", "差异")],
    "配电箱": [("circuit_count", "回路数", "图纸/BOM", "匹配"), ("breaker_brand", "元器件品牌", "报价单", "差异"), ("box_material", "箱体材质", "报价单/投标", "差异"), ("ip_rating", "防护等级", "投标", "匹配")],
    "阀门": [("valve_type", "阀门类型", "报价单/图纸", "匹配"), ("pressure", "公称压力(MPa)", "报价单/投标", "匹配"), ("body_material", "阀体材质", "报价单", "差异"), ("connection", "连接方式", "报价单/图纸", "匹配")],
    "不锈钢管": [("steel_grade", "钢种牌号", "报价单/投标", "匹配"), ("wall_thickness", "壁厚(mm)", "报价单", "差异"), ("connection", "连接方式", "报价单/图纸", "匹配")],
    "水箱": [("tank_material", "材质", "报价单/投标", "匹配"), ("volume", "容积(m³)", "图纸/BOM", "匹配"), ("insulation", "保温方式", "投标", "差异")],
    "潜水泵": [("flow_rate", "流量(m³/h)", "报价单/图纸", "匹配"), ("head", "扬程(m)", "报价单/图纸", "匹配"), ("power", "功率(kW)", "报价单", "差异"), ("material", "过流部件材质", "投标", "差异")],
    "风口风阀": [("type", "类型", "报价单/图纸", "匹配"), ("material", "材质", "报价单/投标", "差异"), ("drive_type", "驱动方式", "投标", "差异")],
    "风机盘管": [("cooling_cap", "制冷量(kW)", "报价单/图纸", "匹配"), ("air_volume", "风量(m³/h)", "报价单/图纸", "匹配"), ("install_type", "安装方式", "投标", "匹配"), ("coil_rows", "盘管排数", "投标", "差异")],
    "空调泵": [("flow_rate", "流量(m³/h)", "报价单/图纸", "匹配"), ("head", "扬程(m)", "报价单/图纸", "匹配"), ("power", "功率(kW)", "报价单", "差异"), ("pump_type", "泵型", "报价单/投标", "匹配")],
}

# The parts of which names of a category are made.
NAMING = {
    "桥架": {"结构形式": ["槽式", "托盘式", "梯式", "网格式", "模压增强型", "波纹型"], "材质": ["钢质", "不锈钢", "铝合金", "玻璃钢", "高分子", "冷轧钢"],
            "表面处理": ["热浸镀锌", "热镀锌", "彩钢", "涂塑", "喷塑", "锌铝镁"], "特殊要求": ["防水", "防火", "带分隔板", "屏蔽"]},
    "风口风阀": {"名称": ["风口", "风阀", "防火阀", "静压箱", "消声器"], "材质": ["镀锌钢", "不锈钢", "铝合金"], "板材厚度": ["1.6mm", "1.8mm", "2.0mm"],
               "特殊要求": ["带门铰", "带防虫网", "带风箱", "带驱动", "带执行机构"]},
}
