"""Fixed values that results depend on: word lists, patterns and tables, stated as they have to be."""

# Language of a file by its extension; anything else counts as TypeScript.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".html": "html", ".htm": "html", ".py": "python", ".ipynb": "python", ".php": "php",
    ".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".go": "go", ".sh": "shell",
    ".bash": "shell", ".zsh": "shell", ".rs": "rust", ".dart": "dart",
}

# Keys that are never taken for a name.
UNSAFE_KEYS = ["__proto__", "constructor", "prototype"]

# A path segment that looks like an identifier.
ID_SEGMENT = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{3,}|[a-z]{1,6}_[A-Za-z0-9]{8,}|[0-9a-f]{16,})\z"

# A host that can name a provider by itself.
PLAIN_HOST = r"(?i)^[a-z0-9._-]+(?::\d+)?\z"

# Environment variables that hold a path prefix; prefixes, suffixes and service words around a provider's name.
PATH_PREFIX_ENV = r"(?i)(?:^|_)(?:BASE_?PATH|BASE_?NAME|PATH_?PREFIX)\z"
ENV_PREFIX = r"^(?:NEXT_PUBLIC_|NUXT_PUBLIC_|EXPO_PUBLIC_|REACT_APP_|VITE_|PUBLIC_|NG_APP_)"
ENV_SUFFIX = r"_(?:API_BASE_URL|BASE_URL|API_URL|ENDPOINT_URL|API_ENDPOINT|ENDPOINT|API_HOST|HOST|HOSTNAME|URL|URI|API_BASE|BASE|DOMAIN)\z"
SERVICE_WORDS = r"_(?:WEBHOOK|API|PROXY|GATEWAY|REST|GRAPHQL|INFERENCE|INGEST|EVENTS|FUNCTIONS)\z"

# Model servers by their local port.
LOCAL_PORTS = {"11434": "ollama", "8188": "comfyui"}

# Top-level domains of private names.
INTERNAL_TLDS = [
    "local", "localhost", "internal", "lan", "home", "corp", "intranet", "localdomain", "test", "example", "invalid", "svc",
    "cluster", "docker", "private", "arpa",
]

# Domains that serve documentation, packages, media or social pages.
NOISE_DOMAINS = [
    "example.com", "example.org", "example.net", "w3.org", "schema.org", "json-schema.org", "xmlns.com", "purl.org", "ogp.me",
    "shields.io", "badgen.net", "wikipedia.org", "wikimedia.org", "npmjs.com", "npmjs.org", "yarnpkg.com", "pypi.org", "pythonhosted.org",
    "python.org", "crates.io", "docs.rs", "pkg.go.dev", "golang.org", "go.dev", "packagist.org", "mvnrepository.com", "maven.org",
    "apache.org", "github.io", "githubusercontent.com", "readthedocs.io", "readthedocs.org", "gitbook.io", "notion.site", "medium.com",
    "dev.to", "stackoverflow.com", "stackexchange.com", "youtube.com", "youtu.be", "twitter.com", "x.com", "linkedin.com", "facebook.com",
    "instagram.com", "tiktok.com", "t.me", "telegram.me", "discord.gg", "reddit.com", "creativecommons.org", "opensource.org", "gnu.org",
    "mozilla.org", "ietf.org", "rfc-editor.org", "iana.org", "gravatar.com", "googleusercontent.com", "gstatic.com", "fonts.googleapis.com",
    "jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "esm.sh", "deno.land", "skypack.dev", "unsplash.com", "placehold.co",
    "placeholder.com", "via.placeholder.com", "picsum.photos", "apple.com", "play.google.com", "microsoft.com", "swagger.io", "openapis.org",
]

# Words and labels of host names, hosts and patterns that tell an API from a page.
DOC_WORDS = ["docs", "doc", "documentation", "developer", "developers", "help", "support", "blog", "status", "community", "forum", "forums", "learn", "wiki", "guide", "guides"]
NOISE_LABELS = [
    "img", "images", "image", "static", "assets", "fonts", "media", "cdn", "avatars", "badge", "badges", "gist", "console", "dashboard",
    "portal", "platform", "studio", "aistudio", "marketplace", "store", "shop", "news", "careers", "jobs",
]
CODE_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "huggingface.co", "codeberg.org"]
GATEWAYS = [".cognitiveservices.azure.com", ".services.ai.azure.com", ".inference.ai.azure.com", ".endpoints.huggingface.cloud", ".modal.run", ".helicone.ai", "gateway.ai.cloudflare.com", ".portkey.ai"]
BARE_TLDS = ["com", "io", "ai", "org", "net", "co", "dev", "app", "cloud", "xyz", "tech", "us", "uk", "de", "fr", "eu", "cn", "jp", "in", "br", "au", "ca"]
CODE_HOST_API = r"^/(?:api|login/oauth|oauth)(?:[/?#]|\z)"
API_PATH = r"(?i)/(?:(?:v\d+(?:\.\d+)?(?:alpha|beta)?\d*|api|graphql|rest)(?=[/?#.]|\z)|bot(?:\{|\$\{|%s|\d+:|\z))"
ASSET_PATH = r"(?i)\.(?:png|jpe?g|gif|svg|webp|ico|css|js|mjs|map|woff2?|ttf|eot|html?|md|pdf|zip|t?gz|whl|mp[34]|wav|txt)\z"
PLACEHOLDER_LABEL = r"^(?:your|example|sample|placeholder|dummy|fake|foo|bar|baz|xxx)"
HOST_LABEL = r"^(?!-)[a-z0-9-]{1,63}(?<!-)\z"
TLD = r"^(?:[a-z]{2,24}|xn--[a-z0-9-]{2,59})\z"
TWO_LEVEL_SUFFIX = r"\.(?:co|com|org|net|gov|ac|edu|ne|or)\.[a-z]{2}\z"

# Paths that are no call.
OAUTH_AUTHORIZE = r"(?i)^(?:/authorize|.*/(?:oauth2?|connect|auth|openidconnect)(?:/v[\d.]+)?/(?:authorize|authenticate)|.*/oauth2?(?:/v[\d.]+)?/auth|.*/openid-connect/auth)/?\z"
GOOGLE_SCOPE = r"^/auth/[a-z]"
GRAPH_SCOPE = r"^/(?:\.default|[A-Z][A-Za-z]*(?:\.[A-Z][A-Za-z]*)+)\z"
DOC_SEGMENTS = ["docs", "doc", "documentation", "reference", "references", "robots", "guide", "guides", "tutorial", "tutorials", "faq", "manual", "changelog", "help", "learn", "wiki", "blog", "pricing", "terms", "privacy", "legal"]
DOC_FIRST = ["docs", "documentation", "reference", "references", "robots", "guides", "tutorials", "faq", "manual", "changelog"]
LOCALE = r"(?i)^[a-z]{2}(?:[-_][a-z]{2})?\z"
FILL_IN = r"(?i)^(?:your[-_]?[a-z0-9].*|x{3,}|changeme|change[-_]me|replace[-_]?me|placeholder|\.\.\.|…|example|sample|dummy|my[-_]?[a-z]+|0{12}|1{12}|123456789012)\z"
GENERIC_CLOUD = r"(?:^|\.)(?:amazonaws\.com(?:\.cn)?|googleapis\.com|windows\.net|azure\.com|digitaloceanspaces\.com|cloudflare\.com)\z"

# Secrets, credential keys and headers.
SECRET = r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|\b[0-9a-f]{32,}\b"
CREDENTIAL_KEY = r"(?i)(?:^|[_-])(?:password|passwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|authorization|credential)s?\z"
APIKEY_HEADERS = ["x-api-key", "api-key", "apikey", "x-auth-token", "x-token", "api_key", "x-access-token", "x-goog-api-key", "anthropic-api-key"]
CREDENTIAL_HEADERS = [*APIKEY_HEADERS, "authorization", "proxy-authorization", "cookie", "set-cookie"]

# Control and direction characters that a terminal must not get.
UNPRINTABLE = r"[\x00-\x1F\x7F-\x9F؜‎‏‪-‮⁦-⁩]"

# Packages named by a CDN's URL.
CDN = r"(?i)^https?://(?:cdn\.jsdelivr\.net/npm/|unpkg\.com/|esm\.sh/(?:v\d+/)?|cdn\.skypack\.dev/|esm\.run/|ga\.jspm\.io/npm:|cdnjs\.cloudflare\.com/ajax/libs/)(@[^/@]+/[^/@?#]+|[^/@?#]+)"

# Tool names of MCP servers, the characters that make them templates, and names that stand for any.
TOOL_NAME = r"(?<![A-Za-z0-9_-])mcp__([A-Za-z0-9-]+(?:_[A-Za-z0-9-]+)*)(?:__([A-Za-z0-9_-]*))?"
PLACEHOLDER_NAMES = [
    "server", "servername", "server_name", "server-name", "myserver", "my_server", "my-server",
    "tool", "toolname", "tool_name", "tool-name", "mytool", "my_tool", "my-tool", "xxx",
]

# Kinds of files that name tools, in their order.
KIND_ORDER = ["settings", "agent", "command", "skill", "instructions", "workflow", "code", "other"]
INSTRUCTION_NAMES = ["CLAUDE.md", "CLAUDE.local.md", "AGENTS.md", "GEMINI.md", ".cursorrules", ".windsurfrules", ".clinerules"]
INSTRUCTION_DIRS = ["/.cursor/rules/", "/.windsurf/rules/", "/.clinerules/", "/.github/instructions/"]
CODE_EXTENSIONS = [
    ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".html",
    ".py", ".php", ".kt", ".kts", ".java", ".go", ".rs", ".dart", ".sh", ".bash", ".zsh", ".rb",
]

# Providers and their hosts (a leading dot: any subdomain), as far as public assertions name them.
PROVIDER_HOSTS = [
    ("api.openai.com", "openai"), ("api.anthropic.com", "anthropic"), ("generativelanguage.googleapis.com", "google-ai"),
    ("maps.googleapis.com", "google-maps"), (".googleapis.com", "google"), ("api.groq.com", "groq"), ("api.mistral.ai", "mistral"),
    ("api.cohere.com", "cohere"), ("api.deepseek.com", "deepseek"), ("api.x.ai", "xai"), ("openrouter.ai", "openrouter"),
    ("api.together.xyz", "together"), ("api.fireworks.ai", "fireworks"), ("api.perplexity.ai", "perplexity"),
    ("api.cerebras.ai", "cerebras"), ("router.huggingface.co", "huggingface"), (".openai.azure.com", "azure-openai"),
    ("api.stripe.com", "stripe"), ("api.github.com", "github"), ("slack.com", "slack"), (".slack.com", "slack"),
    (".supabase.co", "supabase"), (".workers.dev", "cloudflare-workers"), (".my.salesforce.com", "salesforce"),
    ("api.telegram.org", "telegram"), ("api.mailgun.net", "mailgun"), ("formspree.io", "formspree"), ("registry.npmjs.org", "npm"),
]

# Where a model's name routes by its prefix, and the families of names without one.
MODEL_PREFIXES = [
    ("openai", "openai", "api.openai.com", "/v1/chat/completions"), ("openai-chat", "openai", "api.openai.com", "/v1/chat/completions"),
    ("openai-responses", "openai", "api.openai.com", "/v1/responses"), ("anthropic", "anthropic", "api.anthropic.com", "/v1/messages"),
    ("claude", "anthropic", "api.anthropic.com", "/v1/messages"), ("groq", "groq", "api.groq.com", "/openai/v1/chat/completions"),
    ("gemini", "google-ai", "generativelanguage.googleapis.com", "/v1beta/models/{model}:generateContent"),
    ("google", "google-ai", "generativelanguage.googleapis.com", "/v1beta/models/{model}:generateContent"),
    ("mistral", "mistral", "api.mistral.ai", "/v1/chat/completions"), ("cohere", "cohere", "api.cohere.com", "/v2/chat"),
    ("deepseek", "deepseek", "api.deepseek.com", "/chat/completions"), ("xai", "xai", "api.x.ai", "/v1/chat/completions"),
    ("openrouter", "openrouter", "openrouter.ai", "/api/v1/chat/completions"), ("together", "together", "api.together.xyz", "/v1/chat/completions"),
    ("fireworks", "fireworks", "api.fireworks.ai", "/inference/v1/chat/completions"), ("perplexity", "perplexity", "api.perplexity.ai", "/chat/completions"),
    ("cerebras", "cerebras", "api.cerebras.ai", "/v1/chat/completions"), ("huggingface", "huggingface", "router.huggingface.co", "/v1/chat/completions"),
    ("bedrock", "aws-bedrock", "bedrock-runtime.{region}.amazonaws.com", "/model/{model}/converse"), ("ollama", "ollama", "localhost:11434", "/api/chat"),
    ("azure", "azure-openai", "{resource}.openai.azure.com", "/openai/deployments/{model}/chat/completions"),
]
MODEL_FAMILIES = [
    (r"^(gpt-|o\d(-|\z)|chatgpt-|text-embedding-|whisper-|dall-e-|tts-|davinci|babbage|codex-)", "openai"),
    (r"^claude-", "anthropic"), (r"^gemini-|^gemma-", "gemini"), (r"^(command|embed-(english|multilingual))", "cohere"),
    (r"^(mistral-|mixtral-|codestral|open-mistral|pixtral|ministral)", "mistral"), (r"^deepseek-", "deepseek"), (r"^grok-", "xai"),
]

# Keys of links, of requests and of neither; callees that print, log, raise, navigate or format.
LINK_KEYS = [
    "homepage", "homepageurl", "website", "websiteurl", "docs", "docsurl", "doc", "docurl", "documentation",
    "documentationurl", "docslink", "href", "link", "links", "info", "infourl", "moreinfo", "moreinfourl", "learnmore", "learnmoreurl",
    "helpurl", "helplink", "reference", "referenceurl", "termsurl", "privacyurl", "policyurl", "tosurl", "supporturl", "about", "abouturl",
    "scope", "scopes", "redirecturi", "redirecturl", "callbackurl", "callbackuri", "returnurl", "successurl", "cancelurl",
    "authorizationurl", "authorizeurl", "authorizationendpoint", "authorizeendpoint", "userauthorizationurl",
]
WEAK_KEYS = ["url", "uri"]
REQUEST_KEYS = [
    "method", "verb", "httpmethod", "headers", "header", "body", "data", "json", "params", "query", "qs", "form", "formdata", "payload",
    "baseurl", "baseuri", "endpoint", "host", "path", "auth", "authorization", "token", "apikey", "key", "secret", "clientid", "clientsecret",
    "credentials", "timeout", "contenttype", "accept", "model", "region", "proxy", "retries", "agent",
]

# MCP methods whose parameter names a target, and transports.
MCP_TARGETS = {"tools/call": "name", "prompts/get": "name", "resources/read": "uri", "resources/subscribe": "uri", "resources/unsubscribe": "uri"}
MCP_TRANSPORTS = {"sse": "sse", "http": "streamable-http", "streamable-http": "streamable-http", "streamable_http": "streamable-http", "streamableHttp": "streamable-http"}

# Example files of environment variables, their lines, and values that document nothing.
ENV_LINE = r"""^\s*(#\s*)?(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:"([^"\n]*)"|'([^'\n]*)'|([^\s#]*))"""
ENV_VALUE = r"^[A-Za-z0-9][A-Za-z0-9._:/@-]{0,127}\z"
ENV_PLACEHOLDER = r"(?i)your|change-?me|replace|placeholder|todo|^x+\z|^my[-_]|example|^(mock|fake|dummy|stub)([-_.]|\z)"

# The whole domain behind the last placeholder of a host template, and what a placeholder stands for.
TAIL_DOMAIN = r"\.([a-z0-9-]+\.[a-z]{2,})\z"
SOME_LABELS = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*"

# An attribute of an HTML tag.
HTML_ATTRIBUTE = r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?"""

# Packages that serve agents, the text that shows one is used, and what is constructed.
AGENT_SERVERS = [
    ("a2a-sdk", r"\ba2a\.server\b|\bfrom a2a\b", ["A2AStarletteApplication", "A2AFastAPIApplication", "A2ARESTFastAPIApplication", "create_jsonrpc_routes", "create_rest_routes", "create_agent_card_routes", "add_a2a_routes_to_fastapi"]),
    ("@a2a-js/sdk", r"@a2a-js/sdk/server", ["A2AExpressApp", "agentCardHandler", "jsonRpcHandler", "restHandler"]),
    ("google-adk", r"\bgoogle\.adk\.a2a\b", ["to_a2a"]),
    ("strands-agents", r"\bstrands\.multiagent\.a2a\b", ["A2AServer"]),
    ("fasta2a", r"\bfasta2a\b", ["FastA2A"]),
    ("pydantic-ai", r"\bpydantic_ai\b", ["to_a2a"]),
    ("crewai", r"\bcrewai\.a2a\b", ["A2AServerConfig"]),
    ("bedrock-agentcore", r"\bbedrock_agentcore\b", ["serve_a2a"]),
    ("github.com/a2aproject/a2a-go", r"github\.com/a2aproject/a2a-go(?:/v\d+)?/a2asrv", ["a2asrv.NewHandler", "a2asrv.NewJSONRPCHandler", "a2asrv.NewRESTHandler", "a2asrv.NewStaticAgentCardHandler", "a2asrv.NewAgentCardHandler"]),
]

# Where agent cards lie, their fields that tell a version, and how code writes versions and bindings.
CARD_FILE = r"(?:^|/)(\.well-known/agent(?:-card)?\.json)\z"
CARD_FIELDS = ["supportedInterfaces", "preferredTransport", "additionalInterfaces", "supportsAuthenticatedExtendedCard"]
CARD_VERSION = r"""\bprotocol_?[vV]ersion["']?\s*[:=]\s*["'](\d+(?:\.\d+)*)["']"""
CARD_BINDING = r"""\b(?:protocol_?[bB]inding|preferred_?[tT]ransport|transport)["']?\s*[:=]\s*["'](JSONRPC|GRPC|HTTP\+JSON)["']"""
CARD_TRANSPORT = r"\bTransportProtocol\.(JSONRPC|GRPC|HTTP_JSON|jsonrpc|grpc|http_json)\b"
CARD_PATH = r"""["'](/?\.well-known/agent(?:-card)?\.json)["']"""

# Helpers of frameworks that send what one options object says: framework, package (none: a member of
# ``this``), chain, place of the options, method (none: an option), options of the URL, of the body.
FRAMEWORKS = [
    ("n8n", None, "helpers.httpRequest", 0, None, ["url", "uri"], ["body", "form", "formData"]), ("n8n", None, "helpers.request", 0, None, ["url", "uri"], ["body", "form", "formData"]),
    ("n8n", None, "helpers.httpRequestWithAuthentication", 1, None, ["url", "uri"], ["body", "form", "formData"]), ("n8n", None, "helpers.requestWithAuthentication", 1, None, ["url", "uri"], ["body", "form", "formData"]),
    ("n8n", None, "helpers.requestWithAuthenticationPaginated", 1, None, ["url", "uri"], ["body", "form", "formData"]), ("n8n", None, "helpers.requestOAuth2", 1, None, ["url", "uri"], ["body", "form", "formData"]),
    ("n8n", None, "helpers.requestOAuth1", 1, None, ["url", "uri"], ["body", "form", "formData"]),
    ("activepieces", "@activepieces/pieces-common", "httpClient.sendRequest", 0, None, ["url"], ["body"]),
    ("ai-sdk", "@ai-sdk/provider-utils", "postJsonToApi", 0, "POST", ["url"], ["body"]), ("ai-sdk", "@ai-sdk/provider-utils", "postToApi", 0, "POST", ["url"], []),
    ("ai-sdk", "@ai-sdk/provider-utils", "postFormDataToApi", 0, "POST", ["url"], ["formData"]), ("ai-sdk", "@ai-sdk/provider-utils", "getFromApi", 0, "GET", ["url"], []),
]

# Words, names and cities that example values are made of.
EXAMPLE_WORDS = [
    "amber", "harbor", "quiet", "maple", "river", "copper", "meadow", "lantern", "summit", "willow",
    "orbit", "velvet", "canyon", "ember", "falcon", "garden", "horizon", "island", "jasper", "kestrel",
    "lagoon", "marble", "nectar", "onyx", "pebble", "quartz", "ridge", "saffron", "timber", "umber",
    "valley", "walnut", "yarrow", "zephyr", "atlas", "birch", "cedar", "delta", "echo", "fable",
    "glacier", "hollow", "indigo", "juniper", "koala", "linen", "mosaic", "nimbus", "opal", "prairie",
    "quill", "raven", "sable", "tundra", "ultra", "verdant", "wander", "xenon", "yonder", "zenith",
    "anchor", "beacon", "compass", "dune", "estuary", "fjord", "grove", "haven", "inlet", "jetty",
]
EXAMPLE_FIRST = ["Ada", "Bruno", "Chloe", "Dario", "Elena", "Felix", "Greta", "Hugo", "Iris", "Jonas", "Kira", "Leo", "Maya", "Nils", "Olga", "Pablo"]
EXAMPLE_LAST = ["Alder", "Brook", "Castel", "Dumont", "Ekwall", "Ferrer", "Galli", "Hoshi", "Ibarra", "Jansen", "Kovac", "Lindqvist", "Moreau", "Nakamura", "Okafor", "Petrov"]
EXAMPLE_CITIES = ["Lisbon", "Porto", "Lyon", "Bologna", "Ghent", "Bergen", "Tallinn", "Valencia", "Graz", "Utrecht"]

# What a key's name says of its value, the first pattern that fits: pattern, text, number (none: not told).
# In texts {first}, {last}, {word}, {city}, {uuid}, {date} stand for drawn ones, {words 2 /} for words with a separator,
# {Words 2} for capital ones, {int 1 9} for a number between two, {hex 6} and {alnum 8} for characters, {a|b} for one of several.
EXAMPLE_RULES = [
    (r"(?i)e[-_]?mail|^(to|from|cc|bcc|reply[-_]?to|recipient|sender)$", "{lower first}.{lower last}@example.com", None),
    (r"(?i:^(url|uri|href|link|website|homepage|callback|redirect[-_]?uri|redirect|webhook|endpoint)$)|(Url|Uri|Link|Href)$|_(url|uri|link)$", "https://example.com/{words 2 /}", None),
    (r"(?i)uuid|guid", "{uuid}", None),
    (r"(?i)(^|_)(id|ids)$|[a-z]Id$|[a-z]Ids$|^id$", "{alnum 8}", "1 9999"),
    (r"(?i)phone|mobile|^tel$|telephone", "+1415555{int 100 999}{int 0 9}", None),
    (r"(?i)timestamp|_ts$|epoch", "{date}", "1700000000 1760000000"),
    (r"(^|_)(date|time|datetime)($|_)|_at$|(At|Date|Time)$|^(created|updated|deleted|expires|start|end)$", "{date}", "1700000000 1760000000"),
    (r"(?i)^(first[-_]?name|given[-_]?name|firstname)$", "{first}", None),
    (r"(?i)^(last[-_]?name|family[-_]?name|surname|lastname)$", "{last}", None),
    (r"(?i)^(user[-_]?name|username|handle|nickname|login)$", "{lower first}{int 10 99}", None),
    (r"(?i:^(full[-_]?name|display[-_]?name|name|title|subject|label|heading|caption)$)|(Name|Title|Label)$", "{Words 2}", None),
    (r"(?i)description|message|content|text|body|comment|note|summary|bio|reason|prompt|question|answer", "{Words 1} {words 5}.", None),
    (r"(?i)slug|permalink", "{words 2 -}", None), (r"(?i)currency", "usd", None), (r"(?i)country", "US", None),
    (r"(?i)^(lang|language|locale)$", "en-US", None), (r"(?i)timezone|time_zone|^tz$", "Europe/Paris", None),
    (r"(?i)^(city|town)$", "{city}", None), (r"(?i)^(zip|zipcode|postal[-_]?code|postcode)$", "{int 10000 99999}", None),
    (r"(?i)(^|_)(street|address|line1|address1)($|_)", "{int 1 200} {Words 1} Street", None),
    (r"(?i)^(limit|per[-_]?page|perpage|page[-_]?size|pagesize|top|max[-_]?results|count|size|batch[-_]?size)$", "{int 10 100}", "10 100"),
    (r"(?i)^(page|page[-_]?number|offset|skip|start[-_]?index)$", "{int 0 5}", "0 5"),
    (r"(?i)amount|price|total|cost|balance|fee|subtotal|budget", "{int 100 9999}", "100 9999"),
    (r"(?i)quantity|^qty$|^num[-_]|^number[-_]?of", "{int 1 9}", "1 9"), (r"(?i)^(age)$", "{int 20 80}", "20 80"),
    (r"(?i)^(exp[-_]?)?month$", "{int 1 12}", "1 12"), (r"(?i)^(exp[-_]?)?year$", "{int 2027 2030}", "2027 2030"),
    (r"(?i)^(day|day[-_]?of[-_]?month)$", "{int 1 28}", "1 28"), (r"(?i)^(hour|hours)$", "{int 0 23}", "0 23"), (r"(?i)^(minute|minutes|second|seconds)$", "{int 0 59}", "0 59"),
    (r"(?i)^(iban)$", "DE89{int 1000000000 9999999999}{int 10000000 99999999}", None), (r"(?i)^(bic|swift)$", "DEUTDEFF", None),
    (r"(?i)^(card[-_]?number|pan)$", "4242424242424242", None), (r"(?i)^(cvc|cvv)$", "{int 100 999}", None),
    (r"(?i)^(version|api[-_]?version)$", "v{int 1 3}", None), (r"(?i)^(status|state)$", "active", None),
    (r"(?i)^(sort|order|order[-_]?by|direction)$", "{asc|desc}", None), (r"(?i)^(q|query|search|term|keyword|filter)$", "{word}", None),
    (r"(?i)colou?r", "#{hex 6}", None), (r"(?i)^(ip|ip[-_]?address|client[-_]?ip)$", "192.0.2.{int 1 254}", None),
    (r"(?i)mime|content[-_]?type|media[-_]?type", "application/json", None), (r"(?i)file[-_]?name|^filename$", "{word}.pdf", None),
    (r"(?i)^(path|file|file[-_]?path|key|object[-_]?key)$", "{words 2 /}.pdf", None), (r"(?i)domain|hostname|^host$", "{word}.example.org", None),
    (r"(?i)^(sha|hash|digest|checksum|etag)$", "{hex 16}", None), (r"(?i)^(cursor|next|after|before|page[-_]?token|continuation)$", "{alnum 12}", None),
    (r"(?i)^(model)$", "gpt-4o", None), (r"(?i)^(role)$", "user", None), (r"(?i)^(tags?|labels?|categories|category)$", "{word}", None),
    (r"(?i)^(code|coupon|promo[-_]?code|voucher)$", "{upper alnum 6}", None),
]

# Folders out of scope for every language.
SHARED_EXCLUDES = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**"]

# What connects to an MCP server by URL, and the package of the script ones.
MCP_PACKAGE = "@modelcontextprotocol/sdk"
MCP_CONSTRUCTORS = {"StreamableHTTPClientTransport": "streamable-http", "SSEClientTransport": "sse", "streamablehttp_client": "streamable-http", "streamable_http_client": "streamable-http", "sse_client": "sse"}

# GraphQL clients by package: what makes one, and where its endpoint is given (a place, or an option of the
# first argument); functions that take the endpoint first; methods that send.
GRAPHQL_CLIENTS = {
    "graphql-request": {"GraphQLClient": 0}, "@apollo/client": {"ApolloClient": "uri", "HttpLink": "uri", "createHttpLink": "uri"}, "@apollo/client/core": {"ApolloClient": "uri"},
    "urql": {"Client": "url", "createClient": "url"}, "@urql/core": {"Client": "url", "createClient": "url"},
}
GRAPHQL_FUNCTIONS = {"graphql-request": ["request", "rawRequest", "gqlRequest"]}
GRAPHQL_METHODS = ["request", "rawRequest", "batchRequests", "query", "mutate", "mutation", "readQuery"]
