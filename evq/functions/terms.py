"""Default word lists and magnitudes of the text operators."""

# fixed values: factor terms
POSITIVE_TERMS = (
    "降息", "降准", "宽松", "减息", "下调", "一揽子", "组合拳", "减免", "补贴", "扶持", "活跃", "刺激", "提振", "托底", "松绑", "放开", "支持",
    "突破", "超预期", "利好", "降至", "减半", "里程碑", "降税", "扩围", "扩容", "注册制")
NEGATIVE_TERMS = (
    "关税", "制裁", "加征", "报复", "反制", "暴跌", "大跌", "崩盘", "熔断", "黑色", "双减", "整顿", "打压", "处罚", "罚款", "违约", "退市", "爆雷",
    "破产", "债务", "收紧", "禁止", "限制", "冻结", "利空", "风险", "下滑", "萎缩", "衰退", "承压", "重挫", "拖累")
# fixed values: direction words
UP_WORDS = ("利好", "正面", "上涨", "上行", "受益", "提振", "宽松", "积极", "改善", "增长")
DOWN_WORDS = ("利空", "负面", "下跌", "下行", "承压", "冲击", "收紧", "风险", "恶化", "下降", "打压", "重挫", "暴跌", "拖累", "萎缩", "衰退", "关税", "制裁", "限制")
# fixed values: magnitude words from strong to weak
MAGNITUDE_WORDS = (("高", ("高", "显著", "大幅")), ("中", ("中", "温和", "一定程度")), ("低", ("低", "有限", "轻微")))
# fixed values: terms of high impact
HIGH_IMPACT_TERMS = ("关税", "大幅", "一揽子", "双降", "降准", "组合拳", "黑色", "历史最大", "超预期", "暴跌", "大跌", "里程碑")
# fixed values: magnitude of a reasoning step, of a verdict
STEP_MAGNITUDE = {"高": 0.9, "中": 0.5, "低": 0.2, "未知": 0.0}
VERDICT_MAGNITUDE = {"高": 0.9, "中": 0.5, "低": 0.2}
# fixed values: signs in a short free answer
PLUS_MARKS = ("+", "正", "上涨")
MINUS_MARKS = ("-", "−", "负", "下跌")
