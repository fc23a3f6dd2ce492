"""Word lists of the classifier and the inference rules (fixed values).

Repeats are meant: `back end` and `back-end` fold to the same term and count twice."""

from __future__ import annotations

#: family: (strong terms, technology terms, negative terms)
FAMILIES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "backend": (
        ["backend", "back end", "back-end", "server side", "api", "apis", "microservices", "distributed systems", "sistemas distribuidos", "desenvolvedor backend", "engenheiro backend"],
        ["go", "golang", "java", "spring", "spring boot", "node", "node js", "nestjs", "python", "django", "flask", "ruby", "rails", "php", "laravel", "csharp", "dotnet", "postgresql", "mysql", "mongodb", "redis", "kafka", "rabbitmq", "grpc", "rest"],
        [],
    ),
    "frontend": (
        ["frontend", "front end", "front-end", "web developer", "ui engineer", "desenvolvedor frontend", "desenvolvedor front end", "engenheiro frontend"],
        ["react", "next js", "vue", "angular", "svelte", "typescript", "javascript", "html", "css", "tailwind", "graphql"],
        ["designer", "ux", "ui designer", "product designer"],
    ),
    "mobile": (
        ["mobile", "ios", "android", "react native", "flutter", "desenvolvedor mobile", "engenheiro mobile"],
        ["swift", "kotlin", "react native", "flutter", "dart", "android", "ios"],
        [],
    ),
    "fullstack": (
        ["fullstack", "full stack", "full-stack", "desenvolvedor fullstack", "desenvolvedor full stack"],
        ["react", "node", "node js", "typescript", "javascript", "next js", "postgresql", "mongodb"],
        [],
    ),
    "platform": (
        ["platform engineer", "platform software", "plataforma", "developer platform", "engenheiro de plataforma"],
        ["kubernetes", "docker", "terraform", "aws", "azure", "gcp", "google cloud", "ci cd", "github actions", "gitlab ci"],
        [],
    ),
    "devops": (
        ["devops", "site reliability", "sre", "cloud engineer", "infrastructure engineer", "engenheiro devops", "infraestrutura"],
        ["kubernetes", "docker", "terraform", "ansible", "jenkins", "aws", "azure", "gcp", "prometheus", "grafana"],
        [],
    ),
    "data": (
        ["data engineer", "data analyst", "data scientist", "analytics engineer", "machine learning", "ml engineer", "ai engineer", "engenheiro de dados", "cientista de dados", "analista de dados"],
        ["python", "sql", "spark", "airflow", "dbt", "bigquery", "snowflake", "pandas", "tensorflow", "pytorch"],
        [],
    ),
    "qa": (
        ["qa engineer", "test engineer", "automation engineer", "sdet", "quality assurance", "analista qa", "engenheiro qa", "tester"],
        ["selenium", "cypress", "playwright", "jest", "vitest", "junit"],
        [],
    ),
    "security": (
        ["security engineer", "cybersecurity", "application security", "devsecops", "information security", "seguranca da informacao"],
        ["owasp", "iam", "soc", "siem", "vulnerability", "pentest"],
        [],
    ),
    "leadership": (
        ["tech lead", "technical lead", "engineering lead", "engineering manager", "head of engineering", "cto", "lider tecnico", "gerente de engenharia"],
        [],
        [],
    ),
    "software": (
        ["software engineer", "software developer", "engenheiro de software", "desenvolvedor de software", "application developer"],
        [],
        [],
    ),
}

#: technology: aliases
TECHNOLOGIES: dict[str, list[str]] = {
    "angular": ["angular"],
    "aws": ["aws", "amazon web services"],
    "azure": ["azure"],
    "csharp": ["c#", "c sharp", "csharp"],
    "docker": ["docker"],
    "dotnet": [".net", "dotnet", "asp net"],
    "flutter": ["flutter"],
    "gcp": ["gcp", "google cloud"],
    "go": ["go", "golang"],
    "graphql": ["graphql"],
    "java": ["java"],
    "javascript": ["javascript", "js"],
    "kafka": ["kafka"],
    "kotlin": ["kotlin"],
    "kubernetes": ["kubernetes", "k8s"],
    "mongodb": ["mongodb", "mongo db"],
    "mysql": ["mysql"],
    "nestjs": ["nestjs", "nest js"],
    "next.js": ["next js", "nextjs", "next.js"],
    "node.js": ["node js", "nodejs", "node.js"],
    "php": ["php"],
    "postgresql": ["postgresql", "postgres", "postgres sql"],
    "python": ["python"],
    "rabbitmq": ["rabbitmq", "rabbit mq"],
    "react": ["react", "reactjs", "react js"],
    "react-native": ["react native", "react-native"],
    "redis": ["redis"],
    "ruby": ["ruby"],
    "spring": ["spring", "spring boot"],
    "swift": ["swift"],
    "terraform": ["terraform"],
    "typescript": ["typescript", "ts"],
    "vue": ["vue", "vue js", "vuejs"],
}

BLOCKED_TITLES = [
    ("vaga nao concreta", ["banco de talentos", "talent pool", "cadastro reserva"]),
    (
        "vaga administrativa",
        [
            "assistente central de reservas", "central de reservas", "assistente de negocios", "central de relacionamento", "assistente contabil", "assistente financeiro",
            "assistente de autorizacao", "motorista", "motorista de van", "atendente", "analista qualidade", "analista de qualidade",
        ],
    ),
]

SENIOR = ["senior", "sr", "especialista", "lead", "principal", "staff"]
JUNIOR = ["junior", "jr", "entry level", "assistente"]
#: The three inferences of a level differ in their words for trainees only.
TRAINEE_INDEX = ["estagio", "intern", "trainee"]
TRAINEE_CLASSIFIER = ["estagio", "estagiario", "intern", "internship", "trainee"]
TRAINEE_SEARCH = ["estagio", "estagiario", "intern", "internship", "trainee", "aprendiz"]

MODEL_TOKENS = [
    ("hibrido", ["hibrido", "hybrid"]),
    ("remoto", ["remoto", "remote", "home office", "teletrabalho", "anywhere", "worldwide", "global"]),
]
MODEL_STEMS = [
    ("hibrido", ["hibrid", "hybrid"]),
    ("remoto", ["remot", "home office", "teletrabalho", "anywhere", "worldwide"]),
]
CONTRACTS = [
    ("cooperado", ["cooperado", "cooperativa"]),
    ("pj", ["pj", "pessoa juridica", "contractor", "freelance", "freela"]),
    ("clt", ["clt", "full time", "full-time", "efetivo", "permanent"]),
]

#: country, continent, aliases
COUNTRIES = [
    ("Brasil", "América do Sul", ["brasil", "brazil", "br"]),
    ("Estados Unidos", "América do Norte", ["estados unidos", "united states", "usa", "us", "eua"]),
    ("Canadá", "América do Norte", ["canada", "canadá"]),
    ("México", "América do Norte", ["mexico", "méxico"]),
    ("Argentina", "América do Sul", ["argentina"]),
    ("Chile", "América do Sul", ["chile"]),
    ("Colômbia", "América do Sul", ["colombia", "colômbia"]),
    ("Portugal", "Europa", ["portugal"]),
    ("Espanha", "Europa", ["spain", "espanha", "espana", "españa"]),
    ("Reino Unido", "Europa", ["reino unido", "united kingdom", "uk", "england", "london"]),
    ("França", "Europa", ["france", "frança", "franca"]),
    ("Alemanha", "Europa", ["germany", "alemanha", "deutschland"]),
    ("Países Baixos", "Europa", ["netherlands", "paises baixos", "holanda"]),
    ("Índia", "Ásia", ["india", "índia"]),
    ("Singapura", "Ásia", ["singapore", "singapura"]),
    ("Austrália", "Oceania", ["australia", "austrália"]),
    ("Nova Zelândia", "Oceania", ["new zealand", "nova zelandia", "nova zelândia"]),
    ("África do Sul", "África", ["south africa", "africa do sul", "áfrica do sul"]),
]
GLOBAL_WORDS = ["remote", "remoto", "global", "worldwide"]
GLOBAL_LABEL = "Global / Remoto"
STATES = [
    ("SP", ["sp", "sao paulo"]),
    ("RJ", ["rj", "rio de janeiro"]),
    ("MG", ["mg", "minas gerais", "belo horizonte"]),
    ("PR", ["pr", "parana", "curitiba"]),
    ("SC", ["sc", "santa catarina", "florianopolis"]),
    ("RS", ["rs", "rio grande do sul", "porto alegre"]),
    ("BA", ["ba", "bahia", "salvador"]),
    ("PE", ["pe", "pernambuco", "recife"]),
    ("CE", ["ce", "ceara", "fortaleza"]),
    ("DF", ["df", "distrito federal", "brasilia"]),
]
CITIES = [
    "sao paulo", "rio de janeiro", "belo horizonte", "curitiba", "joinville", "florianopolis", "porto alegre", "salvador", "recife", "fortaleza", "brasilia", "lisboa", "porto",
    "madrid", "barcelona", "london", "paris", "berlin", "amsterdam", "toronto", "vancouver", "new york", "san francisco", "singapore", "sydney",
]
SEARCH_COUNTRIES = [
    ("estados unidos", ["estados unidos", "united states", "usa", "eua", "florida", "miami", "new york", "california", "texas", "boston", "seattle", "chicago", "atlanta", "denver"]),
    (
        "brasil",
        [
            "brasil", "brazil", "sao paulo", "rio de janeiro", "minas gerais", "belo horizonte", "parana", "curitiba", "santa catarina", "joinville", "rio grande do sul",
            "porto alegre", "pernambuco", "recife", "bahia", "salvador", "ceara", "fortaleza", "piaui", "teresina",
        ],
    ),
    ("portugal", ["portugal", "lisboa", "porto"]),
]

#: What a title that is accepted as a technology job has, and what it must not have.
NON_CONCRETE = ["banco de talentos", "talent pool", "cadastro reserva"]
HARD_NEGATIVE = [
    "motorista", "motorista de van", "atendente", "operador", "operadora", "promotor", "promotora", "vendedor", "vendedora", "recepcionista",
    "auxiliar", "assistente", "estagiario administrativo", "analista qualidade", "analista de qualidade",
]
STRONG_ROLES = [
    "software engineer", "software developer", "engenheiro de software", "engenheira de software", "arquiteto de software", "arquiteta de software",
    "software architect", "desenvolvedor", "desenvolvedora", "programador", "programadora", "backend", "back end", "frontend", "front end",
    "full stack", "fullstack", "mobile developer", "desenvolvedor mobile", "devops", "site reliability", "sre", "data engineer", "data analyst",
    "analytics engineer", "engenheiro de dados", "cientista de dados", "analista de dados", "qa engineer", "analista qa", "quality assurance", "sdet",
    "security engineer", "engenheiro de seguranca", "cloud engineer", "platform engineer", "go engineer", "tech lead", "technical lead",
]
GENERIC_TITLES = ["analista de sistemas", "arquiteto de software", "arquiteta de software", "software", "tecnologia da informacao"]
SIGNALS = [
    "java", "spring", "python", "django", "fastapi", "php", "laravel", "symfony", "javascript", "typescript", "node", "nodejs", "node js",
    "nestjs", "react", "nextjs", "next js", "react native", "angular", "vue", "golang", "kotlin", "swift", "flutter", "ruby", "rails",
    "dotnet", "csharp", "kubernetes", "docker", "aws", "azure", "gcp", "terraform", "postgresql", "mysql", "mongodb", "redis", "kafka",
]
ROLE_SIGNALS = [
    "developer", "desenvolvedor", "desenvolvedora", "engineer", "engenheiro", "engenheira", "programador", "programadora", "analista de sistemas", "analista desenvolvedor",
]

#: continent of a list's filter: what a location has, first match wins
UI_CONTINENTS = [
    ("América do Norte", ["united states", "estados unidos", "usa", "canada", "canadá", "mexico", "méxico"]),
    ("América do Sul", ["brazil", "brasil", "argentina", "chile", "colombia", "colômbia", "peru", "uruguay", "paraguay", "bolivia", "ecuador", "venezuela"]),
    (
        "Europa",
        [
            "portugal", "spain", "españa", "espanha", "france", "frança", "germany", "alemania", "reino unido", "united kingdom", "uk", "netherlands", "países baixos",
            "holanda", "italy", "irlanda", "poland", "switzerland", "belgium", "austria", "sweden", "norway", "denmark", "finland",
        ],
    ),
    ("Ásia", ["india", "singapore", "japan", "china", "coreia", "korea", "thailand", "vietnam", "malaysia", "indonesia", "philippines", "pakistan", "bangladesh"]),
    ("África", ["south africa", "áfrica do sul", "nigeria", "kenya", "egito", "egypt", "morocco", "marrocos"]),
    ("Oceania", ["australia", "austrália", "new zealand", "nova zelândia"]),
    ("Global / Remoto", ["remote", "remoto", "global", "worldwide"]),
]

#: filter: the work models that it lets through, all of them where none is named
MODEL_FILTERS = {
    "Todos": [],
    "Remoto": ["Remoto"],
    "Híbrido": ["Híbrido"],
    "Presencial": ["Presencial"],
    "RemotoHibrido": ["Remoto", "Híbrido"],
    "RemotoPresencial": ["Remoto", "Presencial"],
    "HibridoPresencial": ["Híbrido", "Presencial"],
}
MENTOR_WORDS, RECRUITER_WORDS = ["mentor", "mentoria"], ["recruiter", "recrutador", "rh"]
